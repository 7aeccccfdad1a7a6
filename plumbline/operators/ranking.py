"""Top-k, caps, exact sampling and order statistics that never send a whole hot group through one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import draws
from plumbline.session import materialise

SALTS = 64


def positions(df: DataFrame, order: list[str | Column], out: str = "position", keys: list[str] | None = None) -> DataFrame:
    """`out` (long): each row's position from 0 in `order`, counted within `keys` when there are any. No task sorts more than its range:
    rows are dealt by ranges of (keys, order), each range is numbered where it lies, and the rows of earlier ranges are added
    as a prefix sum over one small row per range (and key). The numbers are written once, so that later jobs see the same. Rows that
    agree in the whole order are numbered in any order; nulls come first."""
    by = keys or []
    dealt = df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    rows = materialise(dealt.withColumn("_at", F.monotonically_increasing_id()), "positions").withColumn("_range", F.shiftright("_at", 33))
    runs = rows.groupBy(*by, "_range").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # without keys: a row per range
    shift = runs.select(*[F.col(k).alias(f"_of_{k}") for k in by], F.col("_range").alias("_of_range"),
                        (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"))
    same = F.col("_range") == F.col("_of_range")
    for k in by:
        same = same & rows[k].eqNullSafe(F.col(f"_of_{k}"))
    return rows.join(shift if by else F.broadcast(shift), same).select(*df.columns, (F.col("_at") + F.col("_shift")).alias(out))


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int | Column, salt_on: list[str],
                  rank_as: str = "rank") -> DataFrame:
    """The first `k` rows of each group in `order`, with their rank. Each group is first cut to `k` rows in every
    salt, then ranked once more among the survivors, so a group that holds a third of the table is ranked by
    `SALTS` tasks and the last step sees at most k * SALTS rows of it. `k` may be a column that is constant inside a
    group."""
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*salt_on), F.lit(SALTS)))
    part = Window.partitionBy(*keys, "_salt").orderBy(*order)
    whole = Window.partitionBy(*keys).orderBy(*order)
    return (salted.withColumn("_r", F.row_number().over(part)).filter(F.col("_r") <= k).drop("_salt", "_r")
            .withColumn(rank_as, F.row_number().over(whole)).filter(F.col(rank_as) <= k))


def order_statistics(df: DataFrame, keys: list[str], value: str, targets: dict[str, Column],
                     bucket: Column | None = None) -> DataFrame:
    """Exact order statistics per group: `targets` maps an output name to a 1-based rank, given as a column over `n`
    (the group's row count). One row per group with `n` and the chosen values.

    Two passes of pre-aggregated counts instead of a sort of the group: the first counts rows per coarse bucket (a
    step function that never decreases with the value), which shows the bucket that holds each rank; the second counts
    distinct values inside those buckets only."""
    if bucket is None:
        v = F.col(value).cast("double")
        bucket = F.floor(F.signum(v) * F.log1p(F.abs(v)) * 1024)
    data = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"), bucket.alias("_b"))
    if not keys:
        data = data.withColumn("_all", F.lit(0))
    by = keys or ["_all"]
    coarse = data.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_c"))
    seen = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    placed = (coarse.withColumn("_before", F.coalesce(F.sum("_c").over(seen), F.lit(0)))
              .withColumn("n", F.sum("_c").over(Window.partitionBy(*by))))
    wanted = placed.withColumn("_t", F.explode(F.array(*[
        F.struct(F.lit(name).alias("name"), rank.cast("bigint").alias("rank")) for name, rank in targets.items()])))
    wanted = (wanted.filter((F.col("_t.rank") > F.col("_before")) & (F.col("_t.rank") <= F.col("_before") + F.col("_c")))
              .select(*by, "_b", "n", F.col("_t.name").alias("_name"),
                      (F.col("_t.rank") - F.col("_before")).alias("_local")))
    hit_buckets = wanted.select(*by, "_b").distinct()
    fine = (data.join(hit_buckets, [*by, "_b"], "left_semi").groupBy(*by, "_b", "_v")
            .agg(F.count(F.lit(1)).alias("_c")))
    upto = Window.partitionBy(*by, "_b").orderBy("_v")
    fine = fine.withColumn("_end", F.sum("_c").over(upto.rowsBetween(Window.unboundedPreceding, 0)))
    found = (wanted.join(fine, [*by, "_b"])
             .filter((F.col("_local") <= F.col("_end")) & (F.col("_local") > F.col("_end") - F.col("_c"))))
    out = found.groupBy(*by).agg(F.first("n").alias("n"), *[
        F.max(F.when(F.col("_name") == name, F.col("_v"))).alias(name) for name in targets])
    return out if keys else out.drop("_all")


def latency_ranks() -> dict[str, Column]:
    """Ranks for the published latency figures: the two middle values and the value at floor(0.95 * (n - 1))."""
    n = F.col("n")
    return {"mid_lo": F.floor((n - 1) / 2) + 1, "mid_hi": F.ceil((n - 1) / 2) + 1,
            "p95": F.floor(F.lit(0.95) * (n - 1)) + 1}


def sample_rows(df: DataFrame, ids: list[str], n: int | Column, seed: int, keys: list[str] | None = None) -> DataFrame:
    """The `n` rows (or all) of smallest draw, in each of `keys` when there are any; the same ones in every run. The draw of the last one is
    found as an order statistic, then rows are filtered against it, so no task merges or ranks n rows."""
    by = keys or []
    drawn = df.withColumn("_draw", draws.unit(seed, *[F.col(i) for i in ids]))
    most = F.least(F.lit(n) if isinstance(n, int) else n, F.col("n"))
    cut = order_statistics(drawn.select(*by, "_draw"), by, "_draw", {"cut": most}, bucket=F.floor(F.col("_draw") * 1_000_000))
    if not by:
        return drawn.filter(F.col("_draw") <= cut.select("cut").scalar()).drop("_draw")
    same = F.col("_draw") <= F.col("cut")
    for k in by:
        same = same & drawn[k].eqNullSafe(F.col(f"_of_{k}"))
    cuts = cut.select(*[F.col(k).alias(f"_of_{k}") for k in by], "cut")
    return drawn.join(cuts, same).select(*df.columns)


def sample_fraction(df: DataFrame, ids: list[str], fraction: float, seed: int) -> DataFrame:
    """Exactly round(fraction * count) rows: the cut-off draw is found as an order statistic, then rows are filtered
    against it, so no task ranks the whole table."""
    draw = F.col("_draw")
    drawn = df.withColumn("_draw", draws.unit(seed, *[F.col(i) for i in ids]))
    cut = order_statistics(drawn.select("_draw"), [], "_draw", {"cut": F.round(F.lit(fraction) * F.col("n"))},
                           bucket=F.floor(draw * 1_000_000))
    return drawn.filter(draw <= cut.select("cut").scalar()).drop("_draw")


def shuffled(df: DataFrame, ids: list[str], seed: int) -> DataFrame:
    """A seeded shuffle: a range-partitioned sort by the draw."""
    return df.orderBy(draws.rank_key(seed, *[F.col(i) for i in ids]), *ids)


def standings(df: DataFrame, score: str, rank_as: str = "rank") -> DataFrame:
    """Competition rank by `score`, best first; rows without a score stay, without a rank. Ranks are counted over the distinct scores: rows per score are
    pre-aggregated in coarse score bands, and the running total over bands (one small row each) gives every band its
    starting rank; only the scores of one band meet in one task."""
    v = F.col(score).cast("double")
    banded = df.filter(v.isNotNull()).withColumn("_band", F.floor(F.signum(v) * F.log1p(F.abs(v)) * 1024))
    per_score = banded.groupBy("_band", score).agg(F.count(F.lit(1)).alias("_c"))
    bands = per_score.groupBy("_band").agg(F.sum("_c").alias("_bc"))
    higher = Window.orderBy(F.col("_band").desc()).rowsBetween(Window.unboundedPreceding, -1)
    starts = bands.select("_band", F.coalesce(F.sum("_bc").over(higher), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_band").orderBy(F.col(score).desc()).rowsBetween(Window.unboundedPreceding, -1)
    ranks = (per_score.withColumn("_in", F.coalesce(F.sum("_c").over(inside), F.lit(0))).join(starts, "_band")
             .select(score, (F.col("_start") + F.col("_in") + 1).alias(rank_as)))
    return df.join(ranks, score, "left")
