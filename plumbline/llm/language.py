"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of (language, n-gram bucket) are summed over all labelled rows that are not held out; the log-probability matrix, languages x
buckets, is cut by languages into blocks of bounded size, each a broadcast variable, and texts are scored in numpy by adding up the
matrix rows of their n-grams, each as often as it occurs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import fold, small_batches

ORDERS, BUCKETS, LANGUAGES = (1, 2, 3), 1 << 14, 256
FOLDS, HELD_OUT = 3, 1
SMOOTHING, CHUNK_BYTES = 0.5, 1 << 20
UNKNOWN, LEAST_SCORE = "und", 0.5
Model = tuple[list[str], list[np.ndarray]]


def lowered(text: str) -> np.ndarray:
    """Code points of the lower-cased text, runs of other than letters as one space, a space at both ends."""
    codes = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = LETTER[np.minimum(codes, len(LETTER) - 1)]
    return np.where(letter, codes, 32)[letter | np.concatenate([[True], letter[:-1]])]


LETTER = np.array([chr(c).isalpha() for c in range(0x40000)] + [False])  # the planes above hold no letters


def grams(codes: np.ndarray) -> np.ndarray:
    """Buckets of the n-grams of all orders."""
    out, h = [], np.zeros(len(codes), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        h = (h[:len(codes) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1:]) * np.uint64(0xC2B2AE3D27D4EB4F)
        if n in ORDERS:
            out.append((h >> np.uint64(40)) % np.uint64(BUCKETS))
    return np.concatenate(out).astype(np.int64)


def each_text(column: pa.Array) -> Iterator[tuple[int, str]]:
    for i, text in enumerate(column):
        yield i, text.as_py()


def windows(codes: np.ndarray) -> Iterator[np.ndarray]:
    """The code points in bounded pieces that overlap so that no n-gram is lost."""
    for a in range(0, len(codes), CHUNK_BYTES):
        yield codes[a:a + CHUNK_BYTES + max(ORDERS) - 1]


def counts(docs: DataFrame) -> DataFrame:
    """lang, bucket, n over all rows that have text and language and aren't held out."""
    rows = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (fold(F.col("doc_id"), FOLDS) != HELD_OUT)).select("lang", "text")

    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: dict[str, np.ndarray] = {}
        for batch in batches:
            for (_, text), lang in zip(each_text(batch.column(1)), batch.column(0).to_pylist()):
                own = table.setdefault(lang, np.zeros(BUCKETS, np.int64))
                for piece in windows(lowered(text)):
                    own += np.bincount(grams(piece), minlength=BUCKETS)
            if len(table) > LANGUAGES:
                yield from rows_of(table)
                table = {}
        yield from rows_of(table)

    def rows_of(table: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for lang, own in table.items():
            some = np.flatnonzero(own)
            yield pa.record_batch([pa.array([lang] * len(some), pa.string()), pa.array(some, pa.int32()), pa.array(own[some])], ["lang", "bucket", "n"])

    return rows.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, languages: int = LANGUAGES) -> Model:
    """All learned languages, those with the most n-grams first, and their log-probabilities, float32 [buckets, languages], in
    blocks of `languages`: 16 MB for 256."""
    summed = counts(docs).cache()
    try:
        names = [r["lang"] for r in summed.groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "lang").collect()]
        return names, [block(summed, names[a:a + languages]) for a in range(0, len(names), languages)]
    finally:
        summed.unpersist()


def block(summed: DataFrame, names: list[str]) -> np.ndarray:
    got = summed.where(F.col("lang").isin(names)).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("c")).collect()
    at = {name: i for i, name in enumerate(names)}
    matrix = np.full((BUCKETS, len(names)), SMOOTHING)
    for r in got:
        matrix[[c["bucket"] for c in r["c"]], at[r["lang"]]] += [c["n"] for c in r["c"]]
    return np.log(matrix / matrix.sum(axis=0)).astype(np.float32)


def language(text: Column, model: Model) -> Column:
    """(lang_pred, score) of each whole text; `und` and 0 where the text is null or has no letter, or nothing was learned. The
    score is the probability of the language per hundred n-grams of text, so that long texts keep comparable scores."""
    spark = SparkSession.active()
    small_batches(spark)
    names, blocks = spark.sparkContext.broadcast(model[0]), [spark.sparkContext.broadcast(b) for b in model[1]]

    @F.pandas_udf("lang_pred string, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        matrices = [b.value for b in blocks]
        for batch in batches:
            yield pd.DataFrame([scored(t, names.value, matrices) for t in batch], columns=["lang_pred", "score"]).astype({"lang_pred": object, "score": float})
    return run(text)


def scored(text: str | None, names: list[str], matrices: list[np.ndarray]) -> tuple[str, float]:
    codes = lowered(text or "")
    if not names or not (codes != 32).any():
        return UNKNOWN, 0.0
    total, n = np.zeros(len(names)), 0
    for piece in windows(codes):
        found = np.bincount(grams(piece), minlength=BUCKETS)
        some = np.flatnonzero(found)  # the text as a sparse vector
        weights = found[some].astype(np.float32)
        total += np.concatenate([weights @ matrix[some] for matrix in matrices])
        n += int(found.sum())
    best = int(total.argmax())
    return names[best], float(1 / np.exp((total - total[best]) / max(1.0, n / 100)).sum())


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row, repeated ones too; other columns are left out. Null texts and texts without
    a letter are `und`; an empty table gives no rows."""
    return docs.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), language(docs["text"], model).alias("l")).select("doc_id", "held_out", "l.*")


def known(docs: DataFrame, model: Model, least: float = LEAST_SCORE) -> DataFrame:
    """The rows of `docs`, all columns, whose language is recognised with at least that score."""
    return docs.where(language(docs["text"], model)["score"] >= least)
