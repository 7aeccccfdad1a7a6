"""Readers and writers for records, result documents and parquet tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import draws
from plumbline.operators.ranking import top_per_group


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path (or glob) is there, on whatever file system it names."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a fixed schema. Lines end at "\\n" only, since other line separators occur inside strings. A
    missing path reads as an empty table."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("lineSep", "\n").json(path)


def write_records(records: DataFrame, path: str, split: str | None = None, fmt: str = "json", mode: str = "append") -> None:
    """JSON lines or Parquet, one folder per split."""
    writer = records.write.mode(mode).option("lineSep", "\n") if fmt == "json" else records.write.mode(mode)
    (writer.partitionBy(split) if split else writer).format(fmt).save(path)


def append_new(rows: DataFrame, path: str, schema: str, key: str = "id", also_done: DataFrame | None = None) -> DataFrame:
    """The rows whose id is not in the table at `path` (or in `also_done`); writing them there with append resumes an
    interrupted job."""
    done = read_records(rows.sparkSession, path, schema).select(key)
    if also_done is not None:
        done = done.union(also_done.select(key))
    return rows.join(done.distinct(), key, "left_anti")


def write_validated(checked: DataFrame, accepted_path: str, rejects_path: str) -> None:
    """Two sinks for one validated table: accepted rows, and (tid, family, problems) of the others."""
    checked.filter("accepted").drop("accepted").write.mode("append").option("lineSep", "\n").json(accepted_path)
    checked.filter("not accepted").select("tid", "family", "problems").write.mode("append").option("lineSep", "\n").json(rejects_path)


def with_counts(df: DataFrame, **conditions: Column) -> tuple[DataFrame, Observation]:
    """Counts taken while the rows go by on their way to a sink, without a second pass."""
    seen = Observation()
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.count_if(c).alias(n) for n, c in conditions.items()]), seen


def read_per_language(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """One (gzip) JSON-lines file per language, the language taken from the file name."""
    return (spark.read.schema(schema).option("lineSep", "\n").json(pattern)
            .withColumn("lang", F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]+)\.", 1)))


def read_results(spark: SparkSession, runs: list[str], schema: str) -> DataFrame:
    """Result documents (one JSON object per file) of several run folders, in run order."""
    out = None
    for at, folder in enumerate(runs):
        one = (spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", "*.json").json(folder)
               .withColumn("run", F.element_at(F.split(F.lit(folder.rstrip("/")), "/"), -1)).withColumn("run_ord", F.lit(at)))
        out = one if out is None else out.unionByName(one)
    return out.select("run", "run_ord", F.col("benchmark.id").alias("bench_id"), F.col("benchmark.task").alias("task"),
                      F.col("benchmark.dataset").alias("dataset"), "status",
                      F.col("metrics.baseline_adjusted_score").alias("score"))


def sample_per_source(rows: DataFrame, source: str, key: str, cap: int, seed: int = 0, spare: int = 3) -> DataFrame:
    """A stable sample of `spare * cap` rows per source, before any conversion: what a converter that may skip rows
    starts from."""
    return top_per_group(rows, [source], [draws.rank_key(seed, F.col(key)), F.col(key)], cap * spare, [key])
