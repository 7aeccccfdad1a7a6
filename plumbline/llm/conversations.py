"""Conversation prefix trie by ROLLUP.

A conversation's turns are laid out in blocks of `BLOCK` positional turn-id columns. One ROLLUP over these columns, with grouping_id telling
how many of them a group keeps, aggregates all prefixes inside a block together; blocks of longer conversations are grouped below the
node where their prior block ended. A node is named by its depth and two 64-bit sums (exclusive or) of its turns hashed with their
positions, so that the node behind any number of blocks is known without following them one by one.

The smallest member of a node owns it. Whoever owns a node owns all below it on its own path, so each conversation owns one run at the end of
its path: saved tokens and leaves are summed once along that run (from the end) and once, as one number, into the ancestors before it. No
step follows the trie level by level, and no step holds a node's members: a node shared by a third of all conversations is a partial
aggregate, and the hash over member ids reads them from sorted pieces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.mixing import word_count
from plumbline.operators.ranking import positions
from plumbline.session import materialise

BLOCK, SPREAD, HEADS = 8, 20, 4  # turn-id columns; conversations that share a start; a start has fewer turns than this
CHUNK = 4096
PIECE_BYTES = 1 << 20
NODE = ["depth", "n1", "n2"]
TURNS = [f"t{i}" for i in range(1, BLOCK + 1)]
WORDS = [f"w{i}" for i in range(1, BLOCK + 1)]


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, at (0, 1, ... by turn, null first), turn_id (128 bits of the SHA-256 of role and text), words."""
    role, text = (F.coalesce(conversations[c].cast("string"), F.lit("")) for c in ("role", "text"))
    turn_id = F.unhex(F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32))
    rows = conversations.where(conversations["conv_id"].isNotNull()).select(
        conversations["conv_id"].cast("long").alias("conv_id"), conversations["turn"], turn_id.alias("turn_id"), word_count(text).cast("int").alias("words"))
    return positions(rows, ["turn", "turn_id"], "at", ["conv_id"]).drop("turn")


def rebuilt(placed: DataFrame) -> DataFrame:
    """conv_id, d (position from 0), turn_id, words of every rebuilt conversation: the first h turns of conversation c - c % 20, then its own
    after its first h; h = crc32(c) % 4."""
    c = F.col("conv_id")
    first, h = c - c % SPREAD, F.crc32(c.cast("string").cast("binary")) % HEADS
    heads = placed.where(F.col("at") < HEADS - 1).select(c.alias("_first"), F.col("at").alias("d"), "turn_id", "words")
    others = placed.select("conv_id").distinct().select("conv_id", first.alias("_first"), h.alias("_h")).where("_h > 0 and _first <> conv_id")
    borrowed = others.join(heads, "_first").where("d < _h").select("conv_id", "d", "turn_id", "words")  # at most 19 x 3 rows a start
    there = heads.groupBy("_first").agg(F.count(F.lit(1)).alias("_n"))
    short = (others.join(there, "_first", "left").withColumn("_short", F.col("_h") - F.coalesce("_n", F.lit(0)))
             .where("_short > 0").select(F.col("conv_id").alias("_of"), "_short"))
    own = placed.where((F.col("at") >= h) | (first == c)).join(short, c == F.col("_of"), "left")
    return borrowed.unionByName(own.select("conv_id", (F.col("at") - F.coalesce("_short", F.lit(0))).alias("d"), "turn_id", "words"))


def before(df: DataFrame, key: str, at: Column, value: dict[str, Column], total, combine) -> DataFrame:
    """`df` with each of `value` aggregated over the rows of its key that come before in `at` (whole numbers from 0). A key is cut
    into chunks of CHUNK rows, so that a long one has no task to itself; `combine` joins a chunk's start and what lies inside."""
    cut = df.withColumn("_chunk", F.floor(at / CHUNK))
    per = cut.groupBy(key, "_chunk").agg(*[total(v).alias(f"_{n}") for n, v in value.items()])
    whole = Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = per.select(key, "_chunk", *[F.coalesce(total(f"_{n}").over(whole), F.lit(0)).alias(f"_{n}") for n in value])
    inside = Window.partitionBy(key, "_chunk").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    here = cut.withColumns({n: F.coalesce(total(v).over(inside), F.lit(0)) for n, v in value.items()})
    return here.join(starts, [key, "_chunk"]).withColumns({n: combine(F.col(n), F.col(f"_{n}")) for n in value}).drop("_chunk", *[f"_{n}" for n in value])


def lane(number: int, i: int) -> Column:
    """What turn t_i of a block adds to a node's name; nothing where there is no turn."""
    t = F.col(TURNS[i])
    return F.when(t.isNull(), F.lit(0)).otherwise(F.xxhash64(F.lit(number), F.col("block") * BLOCK + i, t))


def xor(columns: list[Column]) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = out.bitwiseXOR(c)
    return out


def blocks(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """conv_id, block, t1.., w1.., size, and the name (p1, p2) of the node where the prior block ended. Every conversation of `ids` has
    block 0, also without turns."""
    slot = F.col("d") % BLOCK
    every = rows.unionByName(ids, allowMissingColumns=True)
    pivot = every.groupBy("conv_id", F.coalesce(F.floor(F.col("d") / BLOCK), F.lit(0)).alias("block")).agg(
        *[F.max(F.when(slot == i, F.col("turn_id"))).alias(t) for i, t in enumerate(TURNS)],
        *[F.max(F.when(slot == i, F.col("words"))).alias(w) for i, w in enumerate(WORDS)], F.count("d").cast("int").alias("size"))
    own = {f"p{n}": xor([lane(n, i) for i in range(BLOCK)]) for n in (1, 2)}
    return before(pivot, "conv_id", F.col("block"), own, F.bit_xor, lambda a, b: a.bitwiseXOR(b))


def prefixes(laid: DataFrame) -> DataFrame:
    """depth, n1, n2, the parent's name (u1, u2), conv_id (smallest member), n_convs, words (of the last turn): all nodes, by one ROLLUP."""
    most = ", ".join(f"max({w}) AS {w}" for w in WORDS)
    groups = laid.sparkSession.sql(
        f"SELECT block, p1, p2, {', '.join(TURNS)}, grouping_id() AS gid, min(conv_id) AS conv_id, count(*) AS n_convs, {most} "
        f"FROM {{laid}} GROUP BY block, p1, p2, ROLLUP({', '.join(TURNS)})", laid=laid)
    kept = F.lit(BLOCK) - F.bit_count("gid")  # how many turn columns the group keeps
    level = groups.withColumn("_kept", kept.cast("int"))
    turn = F.array(*[F.col(t) for t in TURNS])
    real = ((F.col("_kept") == 0) & (F.col("block") == 0)) | (F.col("_kept") > 0) & F.get(turn, F.col("_kept") - 1).isNotNull()
    lanes = {n: [lane(n, i) for i in range(BLOCK)] for n in (1, 2)}
    last = {n: F.coalesce(F.get(F.array(*lanes[n]), F.col("_kept") - 1), F.lit(0)) for n in (1, 2)}
    name = {n: xor([F.col(f"p{n}"), *lanes[n]]) for n in (1, 2)}
    words = F.when(F.col("_kept") == 0, F.lit(0)).otherwise(F.get(F.array(*[F.col(w) for w in WORDS]), F.col("_kept") - 1))
    return level.where(real).select(
        (F.col("block") * BLOCK + F.col("_kept")).alias("depth"), *[name[n].alias(f"n{n}") for n in (1, 2)],
        *[name[n].bitwiseXOR(last[n]).alias(f"u{n}") for n in (1, 2)], "conv_id", "n_convs", words.cast("long").alias("words"))


def path(laid: DataFrame, *also: str) -> DataFrame:
    """depth, n1, n2 and `also` for each node above `top` on each conversation's path, the root too."""
    steps = [F.struct(F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("n1"), F.lit(0).cast("long").alias("n2"), (F.col("block") == 0).alias("there"))]
    for i in range(BLOCK):
        names = [xor([F.col(f"p{n}"), *[lane(n, k) for k in range(i + 1)]]).alias(f"n{n}") for n in (1, 2)]
        steps.append(F.struct((F.col("block") * BLOCK + i + 1).alias("depth"), *names, F.col(TURNS[i]).isNotNull().alias("there")))
    rows = laid.select(*also, "top", F.explode(F.array(*steps)).alias("s"))
    return rows.where("s.there and s.depth < top").select(*also, "s.depth", "s.n1", "s.n2")


def ends_digests(ends: DataFrame) -> DataFrame:
    """depth, n1, n2, ends_sha256 over the ascending, comma-joined ids of `ends` (depth, n1, n2, conv_id). Ids are sorted over all tasks,
    joined into pieces where they lie, and the pieces of a node are hashed one after another: no task holds a node's ids."""
    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ids, size = None, [], 0

        def piece() -> pa.RecordBatch:
            return pa.record_batch([pa.array([x], t) for x, t in zip((*held, ids[0], ",".join(map(str, ids))), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()))], [*NODE, "first", "ids"])

        for batch in batches:
            done: list[pa.RecordBatch] = []
            for *node, conv in zip(*(c.to_pylist() for c in batch.columns)):
                if ids and (node != held or size > PIECE_BYTES):
                    done.append(piece())
                    ids, size = [], 0
                held = node
                ids.append(conv)
                size += 20
            if done:
                yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
        if ids:
            yield piece()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state = None, None
        for batch in batches:
            done = []
            for *node, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4))):
                if node != held:
                    done += [(*held, state.hexdigest())] if held else []
                    held, state = node, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
            if done:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*done), (pa.int64(), pa.int64(), pa.int64(), pa.string()))], [*NODE, "ends_sha256"])
        if held:
            yield pa.record_batch([pa.array([x], t) for x, t in zip((*held, state.hexdigest()), (pa.int64(), pa.int64(), pa.int64(), pa.string()))], [*NODE, "ends_sha256"])

    key = "depth long, n1 long, n2 long"
    order = [*NODE, "conv_id"]
    pieces = ends.select(*[F.col(c).cast("long") for c in order]).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(joined, f"{key}, first long, ids string")
    return pieces.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(hashed, f"{key}, ends_sha256 string")


def trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the rebuilt conversations' prefix trie: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256 (see the module text for how).

    A null role or text counts as empty, a null turn comes first; turns with equal numbers are ordered by a hash of role and text, and
    repeated rows are turns of their own. Rows without a conv_id belong to no conversation and are left out. Other columns are left
    out, whatever their names. An empty table has no conversation and gives no rows, not even a root."""
    placed = turns(conversations)
    laid = materialise(blocks(rebuilt(placed), placed.select("conv_id").distinct()), "turn_blocks")
    nodes = materialise(prefixes(laid), "prefixes")
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("u1").alias("n1"), F.col("u2").alias("n2")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = materialise(nodes.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "nodes")
    own = (F.col("n_convs") - 1) * F.col("words")
    owners = nodes.groupBy("conv_id").agg(F.min(F.struct("depth", "u1", "u2")).alias("top"), F.sum(own).alias("total"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf"))
    above = nodes.select(F.col("conv_id").alias("parent"), *[F.col(c).alias(f"_{c}") for c in NODE])
    same = (F.col("top.depth") - 1 == F.col("_depth")) & (F.col("top.u1") == F.col("_n1")) & (F.col("top.u2") == F.col("_n2"))
    owners = materialise(owners.join(above, same, "left").select("conv_id", F.col("top.depth").alias("top"), "total", "leaf", "parent"), "owners")

    shared = nodes.where("n_convs > 1").withColumn("_up", F.lit((1 << 31) - 1) - F.col("depth"))  # from a path's end upwards
    below = before(shared, "conv_id", F.col("_up"), {"_below": own}, F.sum, lambda a, b: a + b).select(*NODE, (F.col("_below") + own).alias("saved"))

    giving = laid.join(owners.where("total > 0 or leaf > 0"), "conv_id").where(F.col("block") * BLOCK < F.col("top"))
    given = path(giving, "total", "leaf").groupBy(*NODE).agg(F.sum("total").alias("given_tokens"), F.sum("leaf").alias("given_leaves"))

    ends = laid.groupBy("conv_id").agg(F.max(F.struct("block", "size", *[xor([F.col(f"p{n}"), *[lane(n, i) for i in range(BLOCK)]]).alias(f"n{n}") for n in (1, 2)])).alias("e"))
    digests = ends_digests(ends.select((F.col("e.block") * BLOCK + F.col("e.size")).alias("depth"), "e.n1", "e.n2", "conv_id"))

    found = nodes.join(below, NODE, "left").join(given, NODE, "left").join(digests, NODE, "left").join(owners, "conv_id")
    parent = F.when(F.col("depth") == F.col("top"), F.col("parent")).otherwise(F.col("conv_id"))
    return found.select("conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", "n_children",
                        (F.col("leaf") + F.coalesce("given_leaves", F.lit(0))).alias("n_leaves"),
                        (F.coalesce("saved", F.lit(0)) + F.coalesce("given_tokens", F.lit(0))).alias("saved_tokens"),
                        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
