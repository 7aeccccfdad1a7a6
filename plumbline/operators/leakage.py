"""Leakage between training text and evaluation text: exact copies, 13-word shingle containment, trigram copies."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import fixed, text
from plumbline.functions.binding import let
from plumbline.operators.bloom import may_hold
from plumbline.session import broadcast_if_small, fresh_path, materialise, spread

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # task code travels with the job: executors need no copy of the package


def text_pool(*parts: tuple[DataFrame, str]) -> DataFrame:
    """One column `text` from several (table, column) projections; an array column gives one row per element."""
    out = None
    for df, column in parts:
        is_array = dict(df.dtypes)[column].startswith("array")
        one = df.select((F.explode(column) if is_array else F.col(column)).alias("text"))
        out = one if out is None else out.unionByName(one)
    return out.filter(F.col("text").isNotNull())


def evaluation_sets(**parts: DataFrame) -> DataFrame:
    """Named evaluation sets as one table (eval_set, item_id, text); each part has `item_id` and `text`."""
    out = None
    for name, df in parts.items():
        one = df.select(F.lit(name).alias("eval_set"), F.col("item_id").cast("string").alias("item_id"), "text")
        out = one if out is None else out.unionByName(one)
    return out


def _worded(df: DataFrame) -> DataFrame:
    """Rows with at least one word, and their words. Tested on the text: a filter on the word array would be pushed
    below it and split the text a second time."""
    return spread(df.filter(F.col("text").rlike(text.WORD))).withColumn("_words", text.words(F.col("text")))


def _whole(word_array: str) -> list:
    """A 128-bit key of the whole normalised text."""
    return [F.xxhash64(word_array).alias("w1"), F.xxhash64(F.lit("text"), word_array).alias("w2")]


KEY = ["h", "k", "whole"]


def _keys(worded: DataFrame, n: int, *keep: str) -> DataFrame:
    """(keep, grams, h, k, whole): a row per shingle, repeats included, and one for the whole text. Two hashes name a shingle."""
    hashed = F.transform(text.shingles(F.col("_words"), n), lambda g: F.struct(F.xxhash64(g).alias("h"), F.xxhash64(F.lit("second"), g).alias("k"), F.lit(False).alias("whole")))
    counted = let(hashed, lambda p: F.struct(F.size(F.array_distinct(F.transform(p, lambda s: s["h"]))).cast("bigint").alias("grams"), p.alias("keys")))
    whole = F.struct(F.xxhash64(F.lit("text"), "_words").alias("h"), F.xxhash64(F.lit("second text"), "_words").alias("k"), F.lit(True).alias("whole"))
    parts = worded.select(*keep, counted.alias("_f"), F.array(whole).alias("_t"))
    # the outer form keeps the optimizer from testing the array for emptiness, which would build it twice
    return parts.select(*keep, "_f.grams", F.explode_outer(F.concat("_f.keys", "_t")).alias("_k")).select(*keep, "grams", *[f"_k.{c}" for c in KEY])


def pool_keys(pool: DataFrame, n: int = fixed.LEAK_WORDS, test: Callable[[Column], Column] | None = None) -> DataFrame:
    """(h, k, whole): the distinct shingles and whole texts of a pool, of those that `test` lets through."""
    keys = _keys(_worded(pool), n).select(*KEY)
    return (keys.where(test(F.col("h"))) if test else keys).distinct()


def store_pool(pool: DataFrame, n: int = fixed.LEAK_WORDS, buckets: int | None = None) -> DataFrame:
    """The pool's keys as a table bucketed by key, written once where they are made: every task writes its own file of each bucket, side by
    side, so nothing is shuffled, sorted or spilled. Whoever joins it on the key shuffles their own side only, and the pool's texts are not
    read again; a key that comes several times is there several times. There are as many buckets as shuffle partitions at least,
    else the planner would deal the pool anew."""
    spark, name, writers = pool.sparkSession, f"leakage_pool_{uuid.uuid4().hex}", "spark.sql.maxConcurrentOutputFileWriters"
    buckets, before = buckets or max(64, int(spark.conf.get("spark.sql.shuffle.partitions"))), spark.conf.get(writers)
    try:
        spark.conf.set(writers, str(buckets + 1))
        (_keys(_worded(pool), n).select(*KEY).write.bucketBy(buckets, *KEY).format("parquet").option("parquet.block.size", str(4 << 20))
         .option("path", fresh_path(spark, "leakage_pool")).saveAsTable(name))
    finally:
        spark.conf.set(writers, before)
    return spark.table(name)


def _hits(asked: DataFrame, found: DataFrame, keep: list[str]) -> DataFrame:
    met = asked.join(found.withColumn("hit", F.lit(True)), KEY, "left")
    return met.groupBy(*keep).agg(
        F.first("grams").alias("grams"), F.count_if(F.col("hit") & ~F.col("whole")).alias("hits"),
        F.coalesce(F.max(F.col("hit") & F.col("whole")), F.lit(False)).alias("exact"))


def hits_in(stored: DataFrame, items: DataFrame, n: int = fixed.LEAK_WORDS, keep: list[str] | None = None) -> DataFrame:
    """As `shingle_hits`, against keys that `store_pool` wrote with the same `n`. A Bloom filter over the items' keys is tested inside the
    scan of the stored ones, so that of these only what the items may have is shuffled."""
    keep = keep or ["eval_set", "item_id"]
    asked = materialise(_keys(_worded(items), n, *keep).dropDuplicates([*keep, *KEY]), "asked")
    held = stored.where(may_hold(asked, "h")(F.col("h")))
    found = held.join(asked.select(*[F.col(c).alias(f"_{c}") for c in KEY]).distinct(), [F.col(c) == F.col(f"_{c}") for c in KEY]).select(*KEY).distinct()
    return _hits(asked, found, keep)


def shingle_hits(pool: DataFrame, items: DataFrame, n: int = fixed.LEAK_WORDS, keep: list[str] | None = None,
                 large_pool: bool = True) -> DataFrame:
    """Per item (columns `keep`): number of distinct `n`-word shingles, how many of them occur in the pool, and whether
    the whole normalised text does. Items without words are left out.

    The keys of the smaller side (the items with `large_pool`, else the pool) are written once, and a Bloom filter over them, of a fixed
    size, is tested inside the scan of the larger side: of its shingles only those reach a shuffle that the smaller side has,
    and the few that pass wrongly. Both hashes of a key then decide in the join."""
    keep = keep or ["eval_set", "item_id"]
    if large_pool:
        asked = materialise(_keys(_worded(items), n, *keep).dropDuplicates([*keep, *KEY]), "asked")
        return _hits(asked, pool_keys(pool, n, may_hold(asked, "h")), keep)
    held = materialise(pool_keys(pool, n), "pool_keys")
    asked = _keys(_worded(items), n, *keep).where(F.col("whole") | may_hold(held, "h")(F.col("h")))  # an item's row for its whole text always stays
    return _hits(asked.dropDuplicates([*keep, *KEY]), held, keep)


def flag_items(hits: DataFrame, share: float = fixed.LEAK_SHARE) -> DataFrame:
    """`flagged`: an exact copy, or at least `share` of the item's shingles in the pool."""
    near = (F.col("grams") > 0) & (F.col("hits") / F.when(F.col("grams") > 0, F.col("grams")) >= share)
    return hits.withColumn("flagged", F.col("exact") | F.coalesce(near, F.lit(False)))


def leakage_report(flags: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Items, exact copies, near copies (flagged but not exact) and the flagged rate per set."""
    return flags.groupBy(*(by or ["eval_set"])).agg(
        F.count(F.lit(1)).alias("items"), F.count_if("exact").alias("exact"),
        (F.count_if("flagged") - F.count_if("exact")).alias("near"),
        F.round(F.count_if("flagged") / F.count(F.lit(1)), 4).alias("rate"))


def leakage(pool: DataFrame, items: DataFrame, n: int = fixed.LEAK_WORDS) -> DataFrame:
    return leakage_report(flag_items(shingle_hits(pool, items, n)))


def clean_items(items: DataFrame, flags: DataFrame, keys: list[str]) -> DataFrame:
    """The items that were not flagged."""
    return items.join(flags.filter("flagged").select(*keys), keys, "left_anti")


def exact_copies(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of `left` whose normalised `text` also occurs in `right`."""
    other = _worded(right).select(*_whole("_words")).distinct()
    return (_worded(left).select(*left.columns, *_whole("_words"))
            .join(broadcast_if_small(other), ["w1", "w2"], "left_semi").select(*left.columns))


FREQUENT_OF, FREQUENT_CELLS = 8, 1 << 22  # one set in so many is counted for the order of shingles; cells (bytes) that keep how frequent they are
MEET = 16  # near sets have to share one first shingle, and one more for so many that they share in all
COPIES = 4_000_000  # row numbers of repeated sets, up to which they are broadcast


def _places(h: Column) -> Column:
    """The two cells of a shingle, from its lower and its upper bits."""
    return F.array(h.bitwiseAND(F.lit(FREQUENT_CELLS - 1)), F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(FREQUENT_CELLS - 1)))


def _levels(sets: DataFrame) -> np.ndarray:
    """How frequent shingles are, as a sketch of fixed size: for each cell the highest level (log2 of the count) of the shingles that
    share it. The less of a shingle's two cells is its level or more. Only the order of shingles follows from it."""
    counts = sets.select(F.explode("g").alias("h")).groupBy("h").agg(F.floor(F.log2(F.count(F.lit(1)))).cast("int").alias("level")).where("level > 0")
    cells = counts.select(F.explode(_places(F.col("h"))).alias("cell"), "level").groupBy("cell").agg(F.max("level").cast("byte").alias("level")).toArrow()
    out = np.zeros(FREQUENT_CELLS, np.uint8)
    out[cells.column("cell").to_numpy()] = cells.column("level").to_numpy()
    return out


def _heads(sets: DataFrame, levels: np.ndarray, threshold: float, key: str, size: str, at: str) -> DataFrame:
    """(key, size, at, h): the first shingles of each set, rare ones first, of which near sets share some."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = np.int64(len(levels) - 1)
        for batch in batches:
            lists = batch.column(1)
            lengths, h = pc.list_value_length(lists).to_numpy(zero_copy_only=False), lists.flatten().to_numpy()
            owner = np.repeat(np.arange(len(lengths)), lengths)
            level = np.minimum(levels[h & mask], levels[(h >> np.int64(32)) & mask])
            h = h[np.lexsort((h, level, owner))]
            place = np.arange(len(h)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            least = np.maximum(np.ceil(threshold * lengths - 1e-6), 1)
            first = place < (lengths - least + 1 + (least - 1) // MEET)[owner]
            owner = owner[first]
            yield pa.record_batch([batch.column(0).take(pa.array(owner)), pa.array(lengths[owner], pa.int32()), pa.array(place[first], pa.int32()), pa.array(h[first])], [key, size, at, "h"])

    return sets.select("key", "g").mapInArrow(run, f"{key} long, {size} int, {at} int, h long")


def near_copies(texts: DataFrame, bench: DataFrame, id_col: str, n: int = fixed.COPY_WORDS,
                threshold: float = fixed.COPY_JACCARD) -> DataFrame:
    """Texts whose `n`-word shingle set has a Jaccard similarity of at least `threshold` with some benchmark text:
    (id, best similarity). Exact.

    1. Each side's sets are written once, of the benchmark only those whose size some text's allows; equal sets are compared once.
    2. Sets of sizes x and y that are near share at least o = threshold / (1 + threshold) (x + y) shingles. Whatever order the shingles have,
       they share at least k of the first x - o + k and y - o + k, so only such prefixes are joined, by shingle alone, and pairs that
       share fewer go. k is 1 and a sixteenth of o: a few longer prefixes, but texts that merely share a phrase don't become candidates.
    3. The order is by frequency, rare shingles first, so that texts that merely share phrases do not meet. How frequent they are is
       counted in a part of the sets and kept in a sketch of fixed size: it decides on the order only, the same on both sides, and
       never on what is found.
    4. Candidates are checked on the full sets, which are fetched for candidates only."""
    def sets(df: DataFrame, label: str, test: Callable[[Column], Column], *keep: Column) -> DataFrame:
        # the test is made on what a generator gives: a filter on the set itself would be pushed below and build it twice
        made = _worded(df).select(*keep, F.explode_outer(F.array(text.fingerprints(F.col("_words"), n))).alias("g")).where(test(F.size("g")))
        return materialise(made.withColumn("_row", F.monotonically_increasing_id()).withColumn("key", F.xxhash64("g")), label)

    def distinct(held: DataFrame, label: str) -> DataFrame:
        keys = held.select("key", "_row")
        copies = keys.groupBy("key").agg(F.min("_row").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "first")
        again = materialise(keys.join(copies, "key").where("_row <> first").select("_row"), label)
        return held.join(broadcast_if_small(again, COPIES), "_row", "left_anti").select("key", "g")

    least = lambda size: F.ceil(F.lit(threshold) * size - 1e-9).cast("int")

    probe_all = sets(texts, "probe_sets", lambda size: size > 0, F.col(id_col).alias("id"))
    low, high = probe_all.agg(F.min(least(F.size("g"))), F.max(F.size("g"))).first()
    bench_all = sets(bench.select("text"), "bench_sets", lambda size: (size > 0) & (size >= F.lit(low)) & (least(size) <= F.lit(high)))
    probe, others = distinct(probe_all, "probe_again"), distinct(bench_all, "bench_again")
    levels = _levels(probe_all.select("key", "g").union(bench_all.select("key", "g")).where(F.pmod("key", F.lit(FREQUENT_OF)) == 0))
    overlap = F.ceil(F.lit(threshold / (1 + threshold)) * (F.col("an") + F.col("bn")) - 1e-9)
    common = 1 + F.floor((overlap - 1) / MEET)
    pairs = (_heads(probe, levels, threshold, "a", "an", "at_a").join(_heads(others, levels, threshold, "b", "bn", "at_b"), "h")
             .where((F.col("bn") >= least(F.col("an"))) & (F.col("an") >= least(F.col("bn"))) & (F.col("at_a") < F.col("an") - overlap + common) & (F.col("at_b") < F.col("bn") - overlap + common))
             .groupBy("a", "b", "an", "bn").agg(F.count(F.lit(1)).alias("shared")).where(F.col("shared") >= common).select("a", "b"))
    pairs = materialise(pairs, "candidates")

    def asked(df: DataFrame, key: str, out: str) -> DataFrame:
        held = df.join(broadcast_if_small(pairs.select(F.col(key).alias("key")).distinct()), "key", "left_semi")
        return held.select(F.col("key").alias(key), F.col("g").alias(out))

    both = pairs.join(asked(probe, "a", "ga"), "a").join(asked(others, "b", "gb"), "b")
    shared = both.select("a", F.size("ga").alias("an"), F.size("gb").alias("bn"), F.size(F.array_intersect("ga", "gb")).alias("common"))
    near = shared.select("a", (F.col("common") / (F.col("an") + F.col("bn") - F.col("common"))).alias("jaccard")).where(F.col("jaccard") >= threshold)
    best = near.groupBy("a").agg(F.max("jaccard").alias("jaccard"))
    return probe_all.select("id", "key").join(best, F.col("key") == F.col("a")).groupBy(F.col("id").alias(id_col)).agg(F.max("jaccard").alias("jaccard"))
