"""Evaluation metrics over predictions. A prediction row has `probs` (array in option order), `gold_pos` (1-based) and
whatever columns it is grouped by; `scored` adds the columns that the metrics read."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.binding import let
from plumbline.functions import draws, fixed, maths
from plumbline.operators.ranking import latency_ranks, order_statistics, standings

BINS = 10


def scored(predictions: DataFrame) -> DataFrame:
    """Adds top (confidence of the top option), correct, p_gold, bin, nll, brier."""
    p = F.col("probs")
    return (predictions.withColumn("top", F.array_max(p))
            .withColumn("correct", maths.first_top(p) == F.col("gold_pos"))
            .withColumn("p_gold", F.element_at(p, F.col("gold_pos")))
            .withColumn("bin", maths.bin10(F.col("top"), BINS))
            .withColumn("nll", maths.nll(F.col("p_gold")))
            .withColumn("brier", maths.total(F.transform(p, lambda x, i: F.pow(
                x - F.when(i + 1 == F.col("gold_pos"), F.lit(1.0)).otherwise(F.lit(0.0)), F.lit(2.0))))))


def share(flag: Column) -> Column:
    """Mean of a boolean; null over no rows."""
    return F.avg(flag.cast("double"))


def accuracy_by(rows: DataFrame, *groups: str) -> DataFrame:
    """Accuracy overall and by each grouping column, in one pass over the rows: (dimension, member, n, accuracy)."""
    sets = [[], *[[F.col(g)] for g in groups]]
    grouped = rows.groupingSets(sets, *[F.col(g) for g in groups]).agg(
        F.grouping_id().alias("_gid"), F.count(F.lit(1)).alias("n"), share(F.col("correct")).alias("accuracy"))
    name, member = F.lit("all"), F.lit("all")
    for at, g in enumerate(groups):
        mine = F.col("_gid") == F.lit(2 ** len(groups) - 1 - 2 ** (len(groups) - 1 - at))
        name, member = F.when(mine, F.lit(g)).otherwise(name), F.when(mine, F.col(g).cast("string")).otherwise(member)
    return grouped.select(name.alias("dimension"), member.alias("member"), "n", "accuracy")


def pair_accuracy(rows: DataFrame, pair: str = "pair_id") -> DataFrame:
    """Share of pairs with every half right."""
    return rows.groupBy(pair).agg(F.every("correct").alias("both")).agg(
        F.count(F.lit(1)).alias("pairs"), share(F.col("both")).alias("pair_accuracy"))


def reliability(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    return rows.groupBy(*(by or []), "bin").agg(
        F.avg("top").alias("confidence"), share(F.col("correct")).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def calibration_error(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Expected calibration error over the ten bins."""
    table = reliability(rows, by)
    gap = F.sum(F.col("n") * F.abs(F.col("confidence") - F.col("accuracy"))) / F.sum("n")
    return table.groupBy(*(by or [])).agg(gap.alias("ece"))


def worst_families(rows: DataFrame, family: str = "family", n: int = 6) -> DataFrame:
    """The `n` families with the lowest accuracy (three decimals), ties by name."""
    return (rows.groupBy(family).agg(F.round(share(F.col("correct")), 3).alias("accuracy"))
            .orderBy("accuracy", family).limit(n))


def temperature_fit(predictions: DataFrame, logits: str = "logits", low: int = 10, high: int = 60, step: int = 20
                    ) -> DataFrame:
    """The temperature of the grid low/step..high/step with the lowest mean negative log-likelihood, smallest first on
    ties: (temperature, nll). The grid's averages are so many sums of one aggregate; no row is spread."""
    grid = [t / step for t in range(low, high + 1)]
    x, gold = F.col(logits), F.element_at(F.col(logits), F.col("gold_pos"))

    def at(t: Column, top: Column) -> Column:
        z = F.aggregate(x, F.lit(0.0), lambda a, v: a + F.exp((v - top) / t))
        return maths.nll(F.exp((gold - top) / t) / z)

    losses = let(F.array_max(x), lambda top: F.transform(F.array(*[F.lit(t) for t in grid]), lambda t: at(t, top)))
    rows = predictions.select(F.explode_outer(F.array(losses)).alias("s"))  # a generator's output is computed once for all sums
    means = rows.agg(*[F.avg(F.get("s", i)).alias(f"m{i}") for i in range(len(grid))])
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("temperature"), F.col(f"m{i}").alias("nll")) for i, t in enumerate(grid)]))
    return means.select(each.alias("g")).select("g.*").agg(
        F.min_by("temperature", F.struct(F.round("nll", 12), "temperature")).alias("temperature"), F.min("nll").alias("nll"))


def selective(rows: DataFrame, threshold: float = 0.9) -> DataFrame:
    sure = F.col("top") >= threshold
    return rows.agg(F.avg(F.when(sure, F.col("correct").cast("double"))).alias("accuracy"), share(sure).alias("coverage"))


def seconds_of(ts: Column) -> Column:
    """Seconds since 1970 of a timestamp with or without time zone, in the session's zone."""
    return (F.unix_date(F.to_date(ts)) * F.lit(86400.0) + F.hour(ts) * 3600 + F.minute(ts) * 60
            + F.extract(F.lit("SECOND"), ts).cast("double"))


def latency_summary(log: DataFrame, keys: list[str], millis: str, start: str, end: str) -> DataFrame:
    """Requests, p50 (mean of the middle values), p95 (value at floor(0.95 * (n - 1))) and throughput per second."""
    ranked = order_statistics(log, keys, millis, latency_ranks())
    busy = F.max(seconds_of(F.col(end))) - F.min(seconds_of(F.col(start)))
    span = log.filter(F.col(millis).isNotNull()).groupBy(*keys).agg(busy.alias("seconds"))
    both = ranked.join(span, keys) if keys else ranked.withColumn("seconds", span.scalar())
    return both.select(*keys, "n", ((F.col("mid_lo") + F.col("mid_hi")) / 2).alias("p50_ms"), F.col("p95").alias("p95_ms"),
                       F.when(F.col("seconds") > 0, F.col("n") / F.col("seconds")).alias("throughput_per_s"))


def cost_per_million(throughput: Column, hourly: float = fixed.GPU_HOURLY) -> Column:
    return F.lit(hourly * 1e6 / 3600) / throughput


def language_summary(rows: DataFrame, lang: str = "lang", english: str = "en", within: float = 0.10) -> DataFrame:
    """Mean accuracy over languages, the English one, and how many are within `within` of it."""
    table = rows.groupBy(lang).agg(share(F.col("correct")).alias("acc"))
    en = F.coalesce(F.max(F.when(F.col(lang) == english, F.col("acc"))), F.lit(0.0))
    spread = table.agg(F.avg("acc").alias("mean"), F.max(F.when(F.col(lang) == english, F.col("acc"))).alias("english"),
                       F.count(F.lit(1)).alias("languages"), en.alias("_en"), F.collect_list("acc").alias("_all"))
    return spread.select("mean", "english", "languages", F.size(F.filter(
        "_all", lambda a: a >= F.col("_en") - within)).cast("bigint").alias("within"))


def mean_over(rows: DataFrame, members: list[str], lang: str = "lang") -> DataFrame:
    """Mean accuracy over the listed languages (a dozen names, so a plain filter)."""
    return (rows.filter(F.col(lang).isin(members)).groupBy(lang).agg(share(F.col("correct")).alias("acc"))
            .agg(F.avg("acc").alias("mean"), F.count(F.lit(1)).alias("languages")))


def merge_runs(results: DataFrame, bench: str = "bench_id", run_order: str = "run_ord") -> DataFrame:
    """One result per benchmark from several runs: the first complete one in run order, otherwise the last run's."""
    done = F.col("status") == "complete"
    order = F.col(run_order)
    first_done = F.min_by(F.struct("task", "dataset", "status", "score"), F.when(done, order))
    last = F.max_by(F.struct("task", "dataset", "status", "score"), order)
    return results.groupBy(bench).agg(F.coalesce(F.when(F.max(done), first_done), last).alias("r")).select(bench, "r.*")


def task_average(merged: DataFrame, tasks: list[str], exclude: DataFrame | None = None) -> DataFrame:
    """Mean score per task (x100, two decimals; missing scores left out), their mean, and whether all is complete. The
    mean is given only when every benchmark is complete and every task has a score."""
    rows = merged if exclude is None else merged.join(exclude.select("dataset").distinct(), "dataset", "left_anti")
    per = rows.groupBy("task").agg(F.round(F.avg("score") * 100, 2).alias("s"), F.count("score").alias("n"),
                                   F.every(F.col("status") == "complete").alias("ok"))
    cols = [F.max(F.when(F.col("task") == t, F.col("s"))).alias(t) for t in tasks]
    wide = per.agg(*cols, F.sum("n").alias("benchmarks"), F.every("ok").alias("_ok"))
    complete = F.coalesce(F.col("_ok"), F.lit(False))
    mean = F.lit(0.0)
    for t in tasks:
        complete, mean = complete & F.col(t).isNotNull(), mean + F.col(t)
    return wide.select(*tasks, "benchmarks", complete.alias("complete"),
                       F.when(complete, F.round(mean / len(tasks), 2)).alias("task_average"))


def knowledge_rates(judged: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rates of acceptable replies and of replies that invent facts, over all, by answerable and by language, in one
    row (per `by`); null where there is nothing to count."""
    rate = lambda flag, when=None: F.round(F.avg(flag.cast("double") if when is None else
                                                 F.when(when, flag.cast("double"))), 3)
    ok, invents, can, en = F.col("acceptable"), F.col("invents"), F.col("answerable"), F.col("lang").isin("English", "en")
    return judged.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n"), rate(ok).alias("acceptable"), rate(ok, can).alias("answerable"),
                      rate(ok, ~can).alias("unanswerable"), rate(ok, en).alias("english"), rate(ok, ~en).alias("other_languages"),
                      rate(invents).alias("invents"), rate(invents, can).alias("invents_answerable"),
                      rate(invents, ~can).alias("invents_unanswerable"))


def knowledge_rates_by_language(judged: DataFrame) -> DataFrame:
    return judged.groupBy("lang").agg(F.round(share(F.col("acceptable")), 3).alias("acceptable"),
                                      F.round(share(F.col("invents")), 3).alias("invents"), F.count(F.lit(1)).alias("n"))


def win_rate(verdicts: DataFrame) -> DataFrame:
    """Blind pairwise verdicts in both orders ('1': the answer shown first; order 1 shows a first, order 2 shows b
    first). Anything but 1 or 2 is a tie and gives half a point each."""
    first_is_a = F.col("order") == 1
    v = F.substring(F.trim("verdict"), 1, 1)
    b = F.when(v == "1", F.when(first_is_a, 0.0).otherwise(1.0)).when(v == "2", F.when(first_is_a, 1.0).otherwise(0.0)).otherwise(0.5)
    return verdicts.agg(F.count(F.lit(1)).alias("judgements"), F.round(F.avg(F.coalesce(b, F.lit(0.5))), 3).alias("b_win_rate"))


def accuracy_by_type(rows: DataFrame, types: list[str]) -> DataFrame:
    """Overall accuracy over all rows, and per type over rows that did not fail, x100 with one decimal."""
    hit = F.col("correct").cast("double")
    fine = ~F.col("errored")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(hit) * 100, 1).alias("overall"), *[
        F.round(F.avg(F.when(fine & (F.col("type") == t), hit)) * 100, 1).alias(t) for t in types])


def choose_candidate(scores: DataFrame, sets: int = 3) -> DataFrame:
    """Per size the candidate with the best mean over all `sets` validation sets; a missing score rules it out."""
    means = scores.groupBy("size", "candidate").agg(F.count("acc").alias("_n"), F.avg("acc").alias("mean")).filter(F.col("_n") == sets)
    return means.groupBy("size").agg(F.max_by(F.struct("candidate", "mean"), F.struct(F.round("mean", 12), "candidate")).alias("b")
                                     ).select("size", "b.candidate", "b.mean")


def bootstrap_interval(rows: DataFrame, key: str, repeats: int = 200, seed: int = 0, level: float = 0.95) -> DataFrame:
    """Percentile bootstrap of accuracy: (low, high). Each row gets a Poisson(1) weight per repeat from its hash, so resampling needs
    no shuffle of rows; the repeats are summed next to the scan."""
    cuts, total = [], 0.0
    for k in range(12):
        total += math.exp(-1) / math.factorial(k)
        cuts.append(total)
    u = draws.unit(seed, F.col(key), F.col("_b"), salt="bootstrap")
    drawn = rows.select("correct", F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("_b"), key).select("_b", "correct", u.alias("_u"))
    weight = sum(((F.col("_u") >= F.lit(c)).cast("int") for c in cuts), F.lit(0))
    runs = drawn.select("_b", "correct", weight.alias("_w")).groupBy("_b").agg(
        F.try_divide(F.sum(F.col("_w") * F.col("correct").cast("int")), F.sum("_w")).alias("acc"))
    tail = (1 - level) / 2
    return runs.agg(F.percentile("acc", F.lit(tail)).alias("low"), F.percentile("acc", F.lit(1 - tail)).alias("high"))


def average_orders(runs: DataFrame, item: str, key: str = "key", prob: str = "prob") -> DataFrame:
    return runs.groupBy(item, key).agg(F.avg(prob).alias(prob))


def letter_share(tokens: DataFrame, letters: Column) -> DataFrame:
    """Share of items whose top token is an option letter, and mean probability on option letters. `tokens` has `seen`
    (map of trimmed token to probability) and the columns `letters` reads (an array)."""
    entries = F.map_entries("seen")
    top = F.array_max(F.transform(entries, lambda e: F.struct(e["value"].alias("p"), e["key"].alias("t"))))["t"]
    mass = F.aggregate(F.filter(entries, lambda e: F.array_contains(letters, e["key"])), F.lit(0.0), lambda a, e: a + e["value"])
    return tokens.agg(share(F.array_contains(letters, top)).alias("letter_top"), F.avg(mass).alias("letter_mass"))


def leaderboard(local: DataFrame, published: DataFrame, score: str = "score") -> DataFrame:
    """Published rows beside local ones, ranked by score."""
    return standings(local.unionByName(published), score)


def headline(results: DataFrame, task: str = "task", metric: str = "metric") -> DataFrame:
    """One headline metric per benchmark task; a task with two of them is shown as task:metric."""
    twice = {t for t, _ in fixed.HEADLINE_METRICS if sum(t == o for o, _ in fixed.HEADLINE_METRICS) > 1}
    label = F.lit(None).cast("string")
    for t, m in fixed.HEADLINE_METRICS:
        label = F.when((F.col(task) == t) & (F.col(metric) == m), F.lit(f"{t}:{m}" if t in twice else t)).otherwise(label)
    return results.filter(~F.col(task).startswith("mmlu_")).withColumn("label", label).filter(F.col("label").isNotNull())


def metric_rows(section: str, table: DataFrame, system: str | Column, metrics: list[str]) -> DataFrame:
    """A wide result as report rows (section, system, metric, value)."""
    name = F.lit(system) if isinstance(system, str) else system
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    return table.select(F.lit(section).alias("section"), name.alias("system"), F.explode(pairs).alias("m")).select(
        "section", "system", "m.metric", "m.value")


def report(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.filter(F.col("value").isNotNull())


def evaluate(predictions: DataFrame, system: str = "run", family: str = "family") -> DataFrame:
    """The metrics of one prediction table as report rows. The four summaries that need one row come from one pass."""
    rows = scored(predictions)
    one = rows.agg(share(F.col("correct")).alias("accuracy"), F.avg("nll").alias("nll"), F.avg("brier").alias("brier"),
                   F.avg(F.when(F.col("top") >= 0.9, F.col("correct").cast("double"))).alias("selective_accuracy"),
                   share(F.col("top") >= 0.9).alias("coverage"))
    by_family = accuracy_by(rows, family).filter(F.col("dimension") == family)
    return report(metric_rows("summary", one, system, one.columns),
                  metric_rows("summary", calibration_error(rows), system, ["ece"]),
                  by_family.select(F.lit("family").alias("section"), F.lit(system).alias("system"),
                                   F.col("member").alias("metric"), F.col("accuracy").alias("value")))
