"""Session settings and the two places where the engine touches cluster configuration."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "12g", **settings: str) -> SparkSession:
    """A session for tests and single-node runs. On a cluster, build the session with the cluster's own settings."""
    builder = (SparkSession.builder.master(f"local[{cores}]").appName("plumbline")
            .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
            .config("spark.sql.session.timeZone", "UTC")
            .config("spark.driver.memory", memory)
            .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
            .config("spark.sql.adaptive.enabled", "true")
            .config("spark.sql.adaptive.skewJoin.enabled", "true")
            .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``. A local session without one gets a fresh
    temporary folder; any other session must set it, because executors cannot see the driver's disk."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    if "folder" not in _LOCAL:
        _LOCAL["folder"] = tempfile.mkdtemp(prefix="plumbline-")
    return _LOCAL["folder"]


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new, unused path under the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write once, read back. Used after model calls, which must not run twice, and to cut lineage: the written
    table outlives lost executors."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores when a table is so small that a scan would have fewer splits than there are cores; otherwise `df` as
    it is, and streams too. Only the size the plan states is looked at; nothing runs. Text work is CPU-bound, so a small file
    should not end up in one task, and a large one is never moved."""
    if df.isStreaming:
        return df
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return df.repartition(cores) if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < cores * split else df


def fits(df: DataFrame, max_rows: int = 1_000_000) -> bool:
    """Whether `df` has at most `max_rows` rows. Runs one action that stops early."""
    return df.limit(max_rows + 1).agg(F.count(F.lit(1)).alias("n")).first()["n"] <= max_rows


def broadcast_if_small(df: DataFrame, max_rows: int = 1_000_000) -> DataFrame:
    """Broadcast `df` only when a bounded count shows at most `max_rows` rows; otherwise hand it back without a hint,
    so that the join shuffles (and AQE splits skewed partitions). For narrow tables: at 64 bytes a row the default
    means 64 MB."""
    return F.broadcast(df) if fits(df, max_rows) else df
