"""Small pieces that the operators share."""

from __future__ import annotations

import math
import sys
import types
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"


BATCH_ROWS, BATCH_BYTES = 1000, 2 << 20


def small_batches(spark: SparkSession) -> None:
    """At most BATCH_ROWS rows in an Arrow batch of this session, and no further row after BATCH_BYTES: rows hold whole texts, and a task's
    memory follows the batch."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def texts(docs: DataFrame, *also: str) -> DataFrame:
    """Only doc_id, text, a null text as the empty one, and `also`. Other columns, whatever their names, stay out."""
    small_batches(docs.sparkSession)
    return docs.select("doc_id", F.coalesce(docs["text"], F.lit("")).alias("text"), *also)


def fold(doc_id: Column, folds: int) -> Column:
    """CRC-32 of the id as text, modulo `folds`; a null id is in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(0)).cast("int")


def text_bytes(docs: DataFrame) -> int:
    """UTF-8 bytes of all texts: one number, from which groups and partitions are counted."""
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def parts_for(amount: int, each: int, least: int = 1) -> int:
    return max(least, math.ceil(amount / each))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a batch's texts one after another, and where each text starts (one more entry than texts)."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.empty(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows that hold at most `most` bytes (a longer row is a run of its own), so that a task's memory follows
    the longest text, not the batch."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, min(last, rows)
        first = last


def once_per_worker(name: str, make: Callable[[], Any]) -> Any:
    """What `make` returns, made once in each worker process. This package's modules reach workers by value, so their globals are
    made anew for every task; a module of our own in `sys.modules` stays as long as the process."""
    kept = sys.modules.setdefault("_plumbline_kept", types.ModuleType("_plumbline_kept")).__dict__
    if name not in kept:
        kept[name] = make()
    return kept[name]


def bucket(columns: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(buckets)).cast("int")


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], rows: int, out: str, each: int = 100_000) -> DataFrame:
    """`out` (long): each row's position from 0 within its keys, without holes. A group is cut into hashed buckets that
    are numbered on their own and moved by the rows of the buckets before, so that a hot group has no task to itself.
    `df` has to be a written table: it is read twice. `order` names the columns that tell the rows of a group apart."""
    buckets = parts_for(rows, each, 8)
    cut = df.withColumn("_bucket", bucket(order, buckets))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (cut.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
              .select(*keys, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")))
    within = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(*order))
    return (cut.withColumn("_place", within).join(starts, [*keys, "_bucket"])
            .withColumn(out, (F.col("_before") + F.col("_place") - 1).cast("long")).drop("_bucket", "_place", "_before"))
