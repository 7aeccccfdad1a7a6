"""Document fingerprints: a homomorphic multiset hash of paragraphs.

Every paragraph is hashed to a wide vector, and a document's fingerprint is the sum of its paragraphs' vectors: `LANES` numbers
modulo 2^64, for equality, and `BUCKETS` numbers modulo 2^32 that add up signed hashed word shingles, for likeness. The sum does not
depend on the order of paragraphs, and paragraphs are put in or taken out by adding or subtracting their vectors.

Likeness is 2 A.B / (A.A + B.B) for the counts A and B of two texts' shingles, estimated from the buckets: 1 for equal multisets, 0 for
nothing in common. A shingle that stands m times in a text counts m * m, so a line that is repeated often weighs more than the
same number of different lines.
"""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import parts_for, texts
from plumbline.llm.scoring import mixed

LANES, BUCKETS, SHINGLE = 8, 1024, 5
RANGE_BYTES, MOST_RANGES, IDS_A_RANGE = 2 << 20, 20_000, 8
MEMO_ENTRIES = 500_000
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


class Fingerprint:
    def __init__(self, lanes: np.ndarray, sketch: np.ndarray):
        self.lanes, self.sketch = lanes.astype(np.uint64), sketch.astype(np.int32)

    def __add__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.lanes + other.lanes, self.sketch + other.sketch)

    def __sub__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.lanes - other.lanes, self.sketch - other.sketch)

    def __str__(self) -> str:
        return base64.b64encode(self.lanes.astype("<u8").tobytes() + zlib.compress(self.sketch.astype("<i4").tobytes(), 1)).decode()

    def likeness(self, other: Fingerprint) -> float:
        """0 to 1, see the module text; 1 if equal."""
        if (self.lanes == other.lanes).all():
            return 1.0
        square = lambda x: float((x.astype(float) ** 2).sum())
        whole = square(self.sketch) + square(other.sketch)
        return 0.0 if not whole else min(1.0, max(0.0, 1 - square(self.sketch - other.sketch) / whole))


def paragraphs(text: str) -> list[str]:
    return [p for p in text.split("\n") if p]


class Hasher:
    """Fingerprints of texts; remembers the hashes of words."""

    def __init__(self) -> None:
        self.memo: dict[str, int] = {}

    def of(self, text: str) -> Fingerprint:
        import xxhash

        parts = paragraphs(text)
        if len(self.memo) > MEMO_ENTRIES:
            self.memo.clear()
        if not parts:
            return Fingerprint(np.zeros(LANES), np.zeros(BUCKETS))
        whole = np.frombuffer(b"".join(xxhash.xxh3_128_digest(p.encode("utf-8", "surrogatepass")) for p in parts), "<u8").reshape(-1, 2).astype(np.uint64)
        lanes = mixed(whole[:, :1] + whole[:, 1:] * (2 * np.arange(LANES, dtype=np.uint64) + np.uint64(1))).sum(axis=0, dtype=np.uint64)
        words = [p.split() for p in parts]
        flat = [w for ws in words for w in ws]
        hashes = list(map(self.memo.get, flat))
        if None in hashes:
            self.memo.update((w, xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))) for w, h in zip(flat, hashes) if h is None)
            hashes = list(map(self.memo.__getitem__, flat))
        h = np.array(hashes, np.uint64)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        owner = np.repeat(np.arange(len(words)), lengths)
        found = [whole[lengths < SHINGLE, 0]]  # a shorter paragraph is one shingle
        n = len(h) - SHINGLE + 1
        if n > 0:
            total = sum(h[k:k + n] * ODD[k] for k in range(SHINGLE))
            found.append(total[owner[:n] == owner[SHINGLE - 1:]])
        shingles = mixed(np.concatenate(found))
        signs = 1 - 2 * (shingles & np.uint64(1)).astype(np.int64)
        sketch = np.bincount((shingles >> np.uint64(40)).astype(np.int64) % BUCKETS, weights=signs, minlength=BUCKETS)
        return Fingerprint(lanes, sketch.astype(np.int64))


def edited(text: str, following: str) -> str:
    """The last half of the code points (rounded down) replaced by as many of the following text's first, or all of it."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint of each whole text; null counts as empty."""
    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hasher = Hasher()
        for batch in batches:
            yield batch.map(lambda t: str(hasher.of(t)))
    return texts(docs).select("doc_id", run("text").alias("fingerprint"))


COMPARED = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id and `COMPARED` for every row: each text beside its edited form and the text of the next document by ascending
    doc_id (after the last: the first). Null ids come first, rows with equal ids follow each other by text; ids that are no whole
    numbers are ordered as text, by code point. Null and empty texts have the fingerprint of no paragraphs. Other columns are left out,
    whatever their names; an empty table gives no rows.

    Documents are dealt by ranges of doc_id, whose edges come from a bounded sample of ids (any edges give the same rows), and the first document of each range
    goes to the range before as well: neighbours meet in one shuffle of the texts, and a task reads its range in order without
    holding it."""
    whole = docs.schema["doc_id"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))) if whole else F.coalesce(F.concat(F.lit("i"), F.col("doc_id").cast("string")), F.lit(""))
    rows = texts(docs).withColumn("_key", key)
    size, number = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count(F.lit(1))).first()
    ranges = min(MOST_RANGES, parts_for(size, RANGE_BYTES))
    share = min(1.0, IDS_A_RANGE * ranges / max(1, number))
    sample = sorted(r["_key"] for r in rows.select("_key").sample(share, seed=7).collect()) if ranges > 1 else []  # 160,000 ids at most, give or take a few hundred
    edges = sorted({sample[i * len(sample) // ranges] for i in range(1, ranges)}) if sample else []

    @F.pandas_udf("int")
    def part(key: pd.Series) -> pd.Series:
        return pd.Series([bisect_left(edges, k) for k in key.tolist()], dtype=np.int32)

    firsts = sorted((r["part"], r["key"]) for r in rows.select("_key").groupBy(part("_key").alias("part")).agg(F.min("_key").alias("key")).collect())  # one row a range
    before = {key: firsts[i - 1][0] for i, (_, key) in enumerate(firsts)}

    @F.pandas_udf("array<int>")
    def parts(key: pd.Series) -> pd.Series:
        return pd.Series([[p, before[k]] if k in before else [p] for p, k in ((bisect_left(edges, k), k) for k in key.tolist())], dtype=object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, held = Hasher(), None
        for batch in batches:
            out = []
            for number, copy, doc_id, text in zip(*(c.to_pylist() for c in batch.columns[:4])):
                own = hasher.of(text)
                if held is not None and held[0] == number:
                    _, last_id, last_text, last = held
                    new = edited(last_text, text)
                    changed = hasher.of(new)
                    out.append((last_id, len(last_text), sha256(new), str(last), str(changed), last.likeness(changed), last.likeness(own)))
                held = None if copy else (number, doc_id, text, own)
            if out:
                columns = list(zip(*out))
                yield pa.record_batch([pa.array(columns[0], batch.schema.field("doc_id").type), pa.array(columns[1], pa.int64()), *[pa.array(c, pa.string()) for c in columns[2:5]], *[pa.array(c, pa.float64()) for c in columns[5:]]],
                                      ["doc_id", *[x.split()[0] for x in COMPARED.split(", ")]])

    placed = rows.select(F.posexplode(parts("_key")).alias("_copy", "_part"), "doc_id", "text", "_key")
    ordered = placed.repartition("_part").sortWithinPartitions("_part", "_copy", "_key", "text").select("_part", "_copy", "doc_id", "text")
    return ordered.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {COMPARED}")


def sha256(text: str) -> str:
    import hashlib

    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
