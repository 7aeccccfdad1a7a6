"""Toxicity by compression distance: one zstandard dictionary trained on toxic text and one on ordinary text, and the lengths to
which the two compress each window of a text.

A window is one word. zstandard finds no match worth its cost in so few bytes, so a window is written out as the 64-bit codes of its
five-byte pieces, and the dictionaries hold such codes: those of the pieces that set toxic texts apart, and those that ordinary texts
use most. A toxic word then compresses far better with the first. The best and the number of good windows of a text go through a
logistic curve, which is fitted on labelled rows measured with dictionaries that have not seen them.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import fold, small_batches, texts, utf8

PIECE, PIECES = 5, 4096
TOXIC_ROWS, ORDINARY_ROWS = 2000, 6000  # bound of the labelled sample
CONTRAST, LEAST_ROWS = 12.0, 4  # a piece is toxic if that many times as frequent there, and in that many rows
GOOD_GAIN = 5
LEVEL = 3
WINDOW_BYTES = 64
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.3
MEMO_ENTRIES = 250_000


class Model(NamedTuple):
    toxic: bytes
    ordinary: bytes
    weights: tuple[float, float, float]


def windows(text: bytes) -> list[bytes]:
    """The words, each with a space before and behind it; a longer one is cut so that every window is short, and the parts overlap so that
    each of its pieces lies in some part."""
    marked = [b" " + w + b" " for w in text.lower().split()]
    if max(map(len, marked), default=0) <= WINDOW_BYTES + 2:
        return marked
    step = WINDOW_BYTES - PIECE + 1
    return [part for w in marked for part in ([w] if len(w) <= WINDOW_BYTES + 2 else [w[i:i + WINDOW_BYTES] for i in range(0, len(w) - PIECE + 1, step)])]


def pieces(window: bytes) -> list[bytes]:
    return [window[i:i + PIECE] for i in range(max(1, len(window) - PIECE + 1))]


def codes(found: list[bytes]) -> bytes:
    import xxhash

    return b"".join(map(xxhash.xxh64_digest, found))


class Meter:
    """How many bytes shorter a window is with the toxic dictionary."""

    def __init__(self, model: Model):
        import zstandard as zstd

        bare = zstd.ZstdCompressionParameters.from_level(LEVEL, source_size=8 * WINDOW_BYTES, dict_size=8 * PIECES, write_checksum=0, write_content_size=0, write_dict_id=0,
                                                         format=zstd.FORMAT_ZSTD1_MAGICLESS)
        kept = [zstd.ZstdCompressionDict(d, dict_type=zstd.DICT_TYPE_RAWCONTENT) for d in (model.toxic, model.ordinary)]
        for d in kept:
            d.precompute_compress(compression_params=bare)
        self.toxic, self.ordinary = (zstd.ZstdCompressor(dict_data=d, compression_params=bare).compress for d in kept)
        self.memo: dict[bytes, int] = {}

    def gain(self, window: bytes) -> int:
        got = self.memo.get(window)
        if got is None:
            if len(self.memo) > MEMO_ENTRIES:
                self.memo.clear()
            written = codes(pieces(window))
            got = self.memo[window] = len(self.ordinary(written)) - len(self.toxic(written))
        return got

    def features(self, text: str | None) -> tuple[float, float]:
        """The best gain, and the logarithm of one plus the number of good windows."""
        gains = list(map(self.gain, windows((text or "").encode("utf-8", "surrogatepass"))))
        return float(max(gains, default=0)), float(np.log1p(sum(g >= GOOD_GAIN for g in gains)))


def measured(model: Model):
    @F.pandas_udf("best double, good double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        meter = Meter(model)
        for batch in batches:
            yield pd.DataFrame([meter.features(t) for t in batch], columns=["best", "good"], dtype=float)
    return run


def fitted(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Logistic weights (best, good, constant) by Newton steps with a ridge, classes as frequent as they are."""
    if not len(y) or y.min() == y.max():
        return 0.0, 0.0, float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))) if len(y) else -3.0
    design = np.column_stack([x, np.ones(len(x))])
    w, ridge = np.zeros(3), np.diag([0.05, 0.05, 0.01])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        step = np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + ridge, design.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return tuple(map(float, w))


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """toxic (0 or 1), text, half (0 or 1) of at most TOXIC_ROWS and ORDINARY_ROWS labelled documents, those whose hashed id is
    smallest; held-out rows are never taken."""
    usable = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), FOLDS) != HELD_OUT))
    order = F.xxhash64("doc_id", F.lit("toxicity"))
    taken = [usable.where(F.col("toxic") == y).select("doc_id", F.col("toxic").cast("int").alias("toxic")).orderBy(order, "doc_id").limit(n) for y, n in ((1, TOXIC_ROWS), (0, ORDINARY_ROWS))]
    ids = taken[0].union(taken[1]).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))  # at most the two bounds together
    return texts(docs).join(F.broadcast(ids), "doc_id").select("toxic", "text", F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)).cast("int").alias("half"))


def dictionaries(rows: DataFrame) -> tuple[bytes, bytes]:
    """From the number of rows, toxic and ordinary, that have each piece. Pieces are counted where the rows are; only the
    PIECES best of either kind come to the driver. The best stand last, where matches are cheapest."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            toxic = batch.column(0).to_pylist()
            for i in range(batch.num_rows):
                found = list({p for w in set(windows(data[offsets[i]:offsets[i + 1]].tobytes())) for p in pieces(w)})
                yield pa.record_batch([pa.array([toxic[i]] * len(found), pa.int32()), pa.array(found, pa.binary())], ["toxic", "piece"])

    toxic, ordinary = F.sum("toxic"), F.sum(1 - F.col("toxic"))
    counted = rows.select("toxic", "text").mapInArrow(run, "toxic int, piece binary").groupBy("piece").agg(toxic.alias("t"), ordinary.alias("o"))
    n = rows.agg(F.coalesce(toxic, F.lit(0)), F.coalesce(ordinary, F.lit(0))).first()
    stands_out = F.col("t") / max(1, n[0]) - CONTRAST * (F.col("o") + 0.5) / max(1, n[1])
    best = counted.where(F.col("t") >= LEAST_ROWS).withColumn("s", stands_out).where("s > 0").orderBy(F.desc("s"), "piece").limit(PIECES).collect()
    most = counted.orderBy(F.desc("o"), "piece").limit(PIECES).collect()
    return tuple(codes([bytes(r["piece"]) for r in reversed(found)]) or codes([kind]) for found, kind in ((best, b"toxic"), (most, b"ordinary")))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Dictionaries from a bounded labelled sample (see `sample`), and a curve fitted on either half of it with dictionaries of
    the other half. With no labels of either kind the score is one constant."""
    rows = sample(docs, labels).cache()
    flat = (0.0, 0.0, 0.0)
    try:
        seen = []
        for half in (0, 1):
            other = Model(*dictionaries(rows.where(F.col("half") != half).select("toxic", "text")), flat)
            seen.append(rows.where(F.col("half") == half).select("toxic", measured(other)("text").alias("m")).select("toxic", "m.*").toPandas())  # bounded as the sample
        both = pd.concat(seen)
        return Model(*dictionaries(rows.select("toxic", "text")), fitted(both[["best", "good"]].to_numpy(float), both["toxic"].to_numpy(float)))
    finally:
        rows.unpersist()


def score(text: Column, model: Model) -> Column:
    """0 to 1 for each whole text, higher: more likely toxic. Null counts as empty; empty texts have the score of a text
    without any good window."""
    a, b, c = model.weights
    small_batches(SparkSession.active())

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        meter = Meter(model)
        for batch in batches:
            found = np.array([meter.features(t) for t in batch], float).reshape(-1, 2)
            yield pd.Series(1 / (1 + np.exp(-np.clip(found @ [a, b] + c, -60, 60))))
    return run(text)


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for every row, repeated ones too; other columns are left out. Null and empty texts count as
    texts without any good window; an empty table gives no rows."""
    scored = docs.select("doc_id", score(docs["text"], model).alias("score"))
    return scored.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of `docs`, all columns whatever their names, whose score is below the threshold; null and empty texts as in `classify`.
    An empty table gives no rows."""
    return docs.where(score(docs["text"], model) < THRESHOLD)
