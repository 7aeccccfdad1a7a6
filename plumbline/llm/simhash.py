"""SimHash near-duplicates by a segment-popcount embedding.

A 64-bit fingerprint is cut into 32 segments of two bits; the counts of ones in them are its point. One flipped bit moves one count
by one, so the Manhattan distance of two points never exceeds the number of differing bits, and points of linked fingerprints are at
most `BITS` apart. The 32 counts are grouped into blocks; a distance of `BITS` changes at most `BITS` blocks, so linked points share
a grid cell: the counts of some choice of the other blocks. Inside a cell the Manhattan bound is tried first, then the exact bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import slices, texts, utf8
from plumbline.session import materialise

BITS, SHINGLE, SEED = 3, 3, 42
CHUNK_BYTES, CHUNK_SHINGLES = 2 << 20, 100_000
PAIRED, CROWD = 8, 20_000  # cells up to the first are compared pair by pair, cells beyond the second are cut finer
LOW_BITS = 0x5555555555555555


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """The signed 64-bit SimHash over the XXH64 of word shingles, repeats included; fewer words are one shingle, none give 0."""
    import xxhash

    words = text.lower().split()  # bytes: lowers A-Z, splits at ASCII white space
    if not words:
        return 0
    line, size = b" ".join(words), min(size, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:len(words) - size + 1]
    ends = ends[size - 1:]
    ones = np.zeros(64, np.int64)
    for a in range(0, len(starts), CHUNK_SHINGLES):
        some = slice(a, a + CHUNK_SHINGLES)
        shingles = [line[i:j] for i, j in zip(starts[some].tolist(), ends[some].tolist())]
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), "<u8", len(shingles))
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, *also: str) -> DataFrame:
    """doc_id, fp (long) for every row, and the columns `also`."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for a, b in slices(offsets, CHUNK_BYTES):
                fps = [fingerprint(data[offsets[i]:offsets[i + 1]].tobytes()) for i in range(a, b)]
                kept = [batch.column(k).slice(a, b - a) for k in (0, *range(2, batch.num_columns))]
                yield pa.record_batch([kept[0], pa.array(fps, pa.int64()), *kept[1:]], ["doc_id", "fp", *also])

    kinds = "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in also)
    return texts(docs, *also).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long{kinds}")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def embedded(fp: Column) -> Column:
    """The point: 32 counts of 0 to 2, each in the two bits of its segment."""
    high, low = F.shiftrightunsigned(fp, 1), F.lit(LOW_BITS)
    return fp.bitwiseXOR(high).bitwiseAND(low).bitwiseOR(F.shiftleft(fp.bitwiseAND(high).bitwiseAND(low), 1))


def masks(blocks: int, bits: int = BITS) -> list[int]:
    """Bit masks of all choices of `blocks - bits` blocks out of `blocks` runs of segments."""
    edges = [2 * (32 * i // blocks) for i in range(blocks + 1)]
    own = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    return [signed(sum(c)) for c in combinations(own, blocks - bits)]


def cells(points: DataFrame, of: Column, blocks: int, *key: str) -> DataFrame:
    """fp with each of its grid cells."""
    choices = [F.struct(F.lit(i).alias("n"), of.bitwiseAND(F.lit(m)).alias("at")) for i, m in enumerate(masks(blocks))]
    return points.select("fp", *key, F.explode(F.array(*choices)).alias("c")).select("fp", F.xxhash64(*key, "c.n", "c.at").alias("cell"), "c.n", "c.at", *key)


def point(a: np.ndarray) -> np.ndarray:
    """As `embedded`."""
    high, low = a >> np.uint64(1), np.uint64(LOW_BITS)
    return ((a ^ high) & low) | ((a & high & low) << np.uint64(1))


def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Manhattan distance of the points as a lower bound, then the differing bits."""
    x, low = point(a) ^ point(b), np.uint64(LOW_BITS)
    by_one = x & low  # of the counts 0, 1 and 2 only 0 and 2 differ in the upper bit alone
    by_two = (x >> np.uint64(1)) & low & ~by_one
    passed = np.bitwise_count(by_one) + 2 * np.bitwise_count(by_two) <= BITS
    out = np.zeros(passed.shape, bool)
    out[passed] = np.bitwise_count(np.broadcast_to(a, passed.shape)[passed] ^ np.broadcast_to(b, passed.shape)[passed]) <= BITS
    return out


def stars(fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For a large cell: every member with the first one of its component inside the cell; never all pairs."""
    left = fps
    while len(left) > 1:
        root, frontier, left = left[0], left[:1], left[1:]
        while len(frontier) and len(left):
            hit = np.zeros(len(left), bool)
            step = max(1, 2_000_000 // len(left))
            for a in range(0, len(frontier), step):
                open_ones = np.flatnonzero(~hit)
                hit[open_ones[near(left[open_ones][None, :], frontier[a:a + step, None]).any(axis=0)]] = True
            frontier, left = left[hit], left[~hit]
            if len(frontier):
                yield frontier, np.full(len(frontier), root, np.uint64)


def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of fingerprints that keep every cell's components together. Rows come sorted by cell."""
    def links(cell: np.ndarray, fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        _, first, size = np.unique(cell, return_index=True, return_counts=True)
        per_row = np.repeat(size, size)
        small = per_row <= PAIRED
        for d in range(1, PAIRED):
            i = np.flatnonzero(small[:-d] & (cell[:-d] == cell[d:])) if len(cell) > d else np.empty(0, np.int64)
            i = i[near(fps[i], fps[i + d])]
            yield fps[i], fps[i + d]
        for a, n in zip(first[size > PAIRED].tolist(), size[size > PAIRED].tolist()):
            yield from stars(np.unique(fps[a:a + n]))

    def out(cell: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        for a, b in links(cell, fps):
            if len(a):
                yield pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    held_cell, held = np.empty(0, np.int64), np.empty(0, np.uint64)
    for batch in batches:
        cell = np.concatenate([held_cell, batch.column(0).to_numpy()])
        fps = np.concatenate([held, batch.column(1).to_numpy().view(np.uint64)])
        whole = int(np.searchsorted(cell, cell[-1])) if len(cell) else 0  # the last cell may go on in the next batch
        yield from out(cell[:whole], fps[:whole])
        held_cell, held = cell[whole:], fps[whole:]
    yield from out(held_cell, held)


def links(points: DataFrame, n: int) -> DataFrame:
    """a, b: links between distinct fingerprints that have the same components as all links together."""
    blocks = 6 if n < 4_000_000 else 8  # finer cells for more points; either finds every link
    grid = cells(points, embedded(F.col("fp")), blocks)
    crowded = grid.groupBy("cell").count().where(F.col("count") > CROWD).select("cell")
    if crowded.head() is not None:  # cut crowded cells by the bits themselves, which linked members share as well
        inside = cells(grid.join(crowded, "cell", "left_semi").select("fp", F.col("cell").alias("of")), F.col("fp"), 6, "of")
        grid = grid.join(crowded, "cell", "left_anti").select("cell", "fp").unionByName(inside.select("cell", "fp"))
    return grid.select("cell", "fp").repartition("cell").sortWithinPartitions("cell").mapInArrow(linked, "a long, b long").where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root for all nodes of the edges: large-star and small-star steps until nothing changes; each step is a written
    table, so a lost executor costs no more than one step."""
    edges = materialise(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), "edges")
    before = None
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        edges = materialise(small, "edges")
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.count_distinct("u")).first()
        if state == before or state[0] == state[2] and not edges.join(edges.select(F.col("u").alias("v")), "v", "left_semi").head():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))  # every node points at a root that points nowhere
        before = state


def firsts(rows: DataFrame, *order: str) -> DataFrame:
    """fp, root, least for every fingerprint: one root per component, and the component's smallest struct of (id is null, *order)."""
    points = materialise(rows.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), *order)).alias("first")), "points")
    found = components(links(points, points.count()))
    inside = found.select(F.col("node").alias("fp"), "root").union(found.select("root", "root").distinct())
    member = points.join(inside, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "first")
    return member.join(member.groupBy("root").agg(F.min("first").alias("least")), "root").select("fp", "root", "least")


def group(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id for every row: the smallest doc_id that links of `BITS` or fewer differing bits reach. Null and
    empty texts have fingerprint 0 and are linked like any other; rows with equal texts are in one component. Null ids are
    never the smallest unless alone."""
    rows = materialise(fingerprints(docs), "fingerprints")
    return rows.join(firsts(rows, "doc_id"), "fp").select("doc_id", "fp", F.col("least.doc_id").alias("component_id"))
