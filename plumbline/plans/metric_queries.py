"""Evaluation metrics over the driver's tables: vectors stand in for option logits, labels for gold options."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import draws, fixed, maths, text
from plumbline.operators import metrics
from plumbline.operators.ranking import order_statistics
from plumbline.plans.registry import query, sql_unit

LANGS = ["en", "de", "fr", "es", "it"]


def predictions(t):
    """Ten option logits per vector, each the sum of every tenth of its numbers; two neighbouring vectors are the halves of a pair."""
    logits = F.transform(F.sequence(F.lit(1), F.lit(10)), lambda i: F.aggregate(
        F.filter("embedding", lambda x, j: (j + 1) % 10 == i % 10), F.lit(0.0), lambda a, x: a + x.cast("double")) * 20)
    return t.embeddings.select(
        "vec_id", (F.col("label") + 1).alias("gold_pos"), F.floor(F.col("vec_id") / 2).alias("pair_id"),
        F.concat(F.lit("family_"), F.pmod("vec_id", F.lit(7)).cast("string")).alias("family"),
        F.get(F.array(*[F.lit(x) for x in LANGS]), F.pmod("vec_id", F.lit(5)).cast("int")).alias("lang"), logits.alias("logits"))


def scored(t):
    return metrics.scored(predictions(t).withColumn("probs", maths.softmax(F.col("logits"))))


PREDS = """raw AS (SELECT vec_id, label + 1 AS gold_pos, vec_id // 2 AS pair_id, 'family_' || (vec_id % 7) AS family,
        ['en','de','fr','es','it'][vec_id % 5 + 1] AS lang, list_transform(range(1, 11), lambda i: 20 * list_sum(list_transform(list_filter(range(1, len(embedding) + 1), lambda j: j % 10 = i % 10), lambda j: CAST(embedding[j] AS DOUBLE)))) AS logits FROM embeddings),
    ex AS (SELECT *, list_transform(logits, lambda x: exp(x - list_max(logits))) AS e FROM raw),
    pr AS (SELECT *, list_transform(e, lambda x: x / list_sum(e)) AS probs FROM ex),
    scored AS (SELECT *, list_max(probs) AS top, list_position(probs, list_max(probs)) = gold_pos AS correct, probs[gold_pos] AS p_gold,
        (SELECT count(*) FROM range(1, 10) r(b) WHERE list_max(probs) > b / 10.0::DOUBLE) AS bin FROM pr)"""


@query("option_probabilities", f"WITH {PREDS} SELECT vec_id, i - 1 AS pos, round(probs[i], 6) AS prob FROM pr, range(1, 11) r(i)")
def option_probabilities(t):
    return scored(t).select("vec_id", F.posexplode("probs").alias("pos", "prob")).select(
        "vec_id", F.col("pos").cast("bigint").alias("pos"), F.round("prob", 6).alias("prob"))


@query("confidence", f"""WITH {PREDS} SELECT vec_id, round(greatest(0, 1 + list_sum(list_transform(probs, lambda p: p * ln(p))) / ln(10)), 4) AS confidence FROM pr""")
def confidence(t):
    return scored(t).select("vec_id", maths.confidence(F.col("probs")).alias("confidence"))


@query("argmax", f"""WITH {PREDS}, r AS (SELECT vec_id, list_transform(probs, lambda p: round(p, 1)) AS r FROM pr)
    SELECT vec_id, CAST(list_position(r, list_max(r)) AS INTEGER) AS first_top FROM r""")
def argmax(t):
    return scored(t).select("vec_id", maths.first_top(F.transform("probs", lambda p: F.round(p, 1))).alias("first_top"))


@query("accuracy_by_group", f"""WITH {PREDS} SELECT 'all' AS dimension, 'all' AS member, count(*) AS n, round(avg(CAST(correct AS DOUBLE)), 6) AS accuracy FROM scored
    UNION ALL SELECT 'family', family, count(*), round(avg(CAST(correct AS DOUBLE)), 6) FROM scored GROUP BY family
    UNION ALL SELECT 'lang', lang, count(*), round(avg(CAST(correct AS DOUBLE)), 6) FROM scored GROUP BY lang""")
def accuracy_by_group(t):
    return metrics.accuracy_by(scored(t), "family", "lang").withColumn("accuracy", F.round("accuracy", 6))


@query("label_accuracy_by_group", """WITH x AS (SELECT d.source, d.lang, l.quality = 1 AS correct FROM labels l JOIN documents d USING (doc_id))
    SELECT 'all' AS dimension, 'all' AS member, count(*) AS n, round(avg(CAST(correct AS DOUBLE)), 6) AS accuracy FROM x
    UNION ALL SELECT 'source', source, count(*), round(avg(CAST(correct AS DOUBLE)), 6) FROM x GROUP BY source
    UNION ALL SELECT 'lang', lang, count(*), round(avg(CAST(correct AS DOUBLE)), 6) FROM x GROUP BY lang""")
def label_accuracy_by_group(t):
    rows = t.labels.join(t.documents.select("doc_id", "source", "lang"), "doc_id").withColumn("correct", F.col("quality") == 1)
    return metrics.accuracy_by(rows, "source", "lang").withColumn("accuracy", F.round("accuracy", 6))


@query("pair_accuracy", f"""WITH {PREDS}, p AS (SELECT pair_id, bool_and(correct) AS ok FROM scored GROUP BY 1)
    SELECT count(*) AS pairs, round(avg(CAST(ok AS DOUBLE)), 6) AS pair_accuracy FROM p""")
def pair_accuracy(t):
    return metrics.pair_accuracy(scored(t)).withColumn("pair_accuracy", F.round("pair_accuracy", 6))


@query("calibration_error", f"""WITH {PREDS}, b AS (SELECT bin, count(*) AS n, abs(avg(top) - avg(CAST(correct AS DOUBLE))) AS gap FROM scored GROUP BY bin)
    SELECT round(sum(n * gap) / sum(n), 6) AS ece FROM b""")
def calibration_error(t):
    return metrics.calibration_error(scored(t)).withColumn("ece", F.round("ece", 6))


@query("reliability_table", f"""WITH {PREDS} SELECT CAST(bin AS INTEGER) AS bin, round(avg(top), 6) AS confidence,
    round(avg(CAST(correct AS DOUBLE)), 6) AS accuracy, count(*) AS n FROM scored GROUP BY bin""")
def reliability_table(t):
    return metrics.reliability(scored(t)).select("bin", F.round("confidence", 6).alias("confidence"), F.round("accuracy", 6).alias("accuracy"), "n")


@query("log_loss_and_brier", f"""WITH {PREDS} SELECT family, round(avg(-ln(greatest(p_gold, 1e-9))), 6) AS nll,
    round(avg(list_sum(list_transform(probs, lambda p: p * p)) - 2 * p_gold + 1), 6) AS brier FROM scored GROUP BY family""")
def log_loss_and_brier(t):
    return scored(t).groupBy("family").agg(F.round(F.avg("nll"), 6).alias("nll"), F.round(F.avg("brier"), 6).alias("brier"))


@query("worst_families", f"""WITH {PREDS} SELECT family, round(avg(CAST(correct AS DOUBLE)), 3) AS accuracy FROM scored GROUP BY family ORDER BY 2, 1 LIMIT 6""")
def worst_families(t):
    return metrics.worst_families(scored(t))


@query("temperature_fit", f"""WITH {PREDS}, g AS (SELECT t / 20.0::DOUBLE AS temperature FROM range(10, 61) r(t)),
    per AS (SELECT temperature, avg(-ln(greatest(exp((logits[gold_pos] - list_max(logits)) / temperature)
        / list_sum(list_transform(logits, lambda x: exp((x - list_max(logits)) / temperature))), 1e-9))) AS nll FROM raw, g GROUP BY 1)
    SELECT temperature, round(nll, 6) AS nll FROM per ORDER BY round(nll, 12), temperature LIMIT 1""")
def temperature_fit(t):
    return metrics.temperature_fit(predictions(t)).withColumn("nll", F.round("nll", 6))


@query("selective_accuracy", f"""WITH {PREDS} SELECT round(avg(CAST(correct AS DOUBLE)) FILTER (top >= 0.9), 6) AS accuracy,
    round(avg(CAST(top >= 0.9 AS DOUBLE)), 6) AS coverage FROM scored""")
def selective_accuracy(t):
    return metrics.selective(scored(t)).select(F.round("accuracy", 6).alias("accuracy"), F.round("coverage", 6).alias("coverage"))


@query("bootstrap_interval", f"""WITH {PREDS}, cuts AS (SELECT sum(exp(-1) / factorial(CAST(k AS INTEGER))) OVER (ORDER BY k) AS c FROM range(0, 12) r(k)),
    u AS (SELECT b, correct, {sql_unit('vec_id', 'b', salt='bootstrap')} AS u FROM scored, range(1, 201) r(b)),
    w AS (SELECT b, correct, (SELECT count(*) FROM cuts WHERE u >= c) AS w FROM u),
    acc AS (SELECT b, sum(w * CAST(correct AS INTEGER)) / sum(w) AS acc FROM w GROUP BY b)
    SELECT round(quantile_cont(acc, 0.025), 6) AS low, round(quantile_cont(acc, 0.975), 6) AS high FROM acc""")
def bootstrap_interval(t):
    return metrics.bootstrap_interval(scored(t), "vec_id").select(F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query("order_average", """WITH k AS (SELECT vec_id, i AS pos, CAST(embedding[i] AS DOUBLE) AS a, CAST(embedding[65 - i] AS DOUBLE) AS b FROM embeddings, range(1, 65) r(i))
    SELECT vec_id, CAST(pos AS VARCHAR) AS key, round((a + b) / 2, 6) AS prob FROM k""")
def order_average(t):
    shown = F.col("embedding")
    runs = t.embeddings.select("vec_id", F.posexplode(shown).alias("i", "p")).unionByName(
        t.embeddings.select("vec_id", F.posexplode(F.reverse(shown)).alias("i", "p")))
    runs = runs.select("vec_id", (F.col("i") + 1).cast("string").alias("key"), F.col("p").cast("double").alias("prob"))
    return metrics.average_orders(runs, "vec_id").withColumn("prob", F.round("prob", 6))


@query("letter_share", """WITH s AS (SELECT vec_id, chr(CAST(65 + (i - 1) % 10 AS INTEGER)) AS token, sum(exp(CAST(embedding[i] AS DOUBLE))) AS p FROM embeddings, range(1, 65) r(i) GROUP BY ALL),
    t AS (SELECT vec_id, max_by(token, p) AS top, sum(p) FILTER (token IN ('A','B','C','D')) AS mass FROM s GROUP BY vec_id)
    SELECT round(avg(CAST(top IN ('A','B','C','D') AS DOUBLE)), 6) AS letter_top, round(avg(mass), 6) AS letter_mass FROM t""")
def letter_share(t):
    """The numbers are log-probabilities of ten tokens, each with no, one or more leading spaces."""
    letter = lambda i: F.substring(F.lit(fixed.LETTERS), F.pmod(i, F.lit(10)) + 1, F.lit(1))
    tokens = F.transform("embedding", lambda x, i: F.struct(
        F.concat(F.repeat(F.lit(" "), F.floor(i / 10).cast("int")), letter(i)).alias("token"), x.cast("double").alias("logprob")))
    seen = t.embeddings.select(maths.token_mass(tokens).alias("seen"))
    out = metrics.letter_share(seen, F.array(*[F.lit(c) for c in "ABCD"]))
    return out.select(F.round("letter_top", 6).alias("letter_top"), F.round("letter_mass", 6).alias("letter_mass"))


@query("letter_probabilities", """WITH s AS (SELECT vec_id, (i - 1) % 8 + 1 AS i, sum(exp(CAST(embedding[i] AS DOUBLE))) AS p FROM embeddings, range(1, 65) r(i) GROUP BY 1, 2),
    f AS (SELECT vec_id, min(p) * 0.5 AS floor FROM s GROUP BY 1),
    o AS (SELECT vec_id, i FROM embeddings, range(1, 11) r(i)),
    r AS (SELECT o.vec_id, o.i, power(coalesce(s.p, f.floor), 1 / 1.5) AS raw FROM o JOIN f USING (vec_id) LEFT JOIN s ON s.vec_id = o.vec_id AND s.i = o.i)
    SELECT vec_id, i - 1 AS pos, round(raw / sum(raw) OVER (PARTITION BY vec_id), 6) AS prob FROM r""")
def letter_probabilities(t):
    """Eight of ten option letters are seen, in eight spellings each; the other two get the floor."""
    letter = lambda i: F.substring(F.lit(fixed.LETTERS), F.pmod(i, F.lit(8)) + 1, F.lit(1))
    tokens = F.transform("embedding", lambda x, i: F.struct(
        F.concat(F.repeat(F.lit(" "), F.floor(i / 8).cast("int")), letter(i)).alias("token"), x.cast("double").alias("logprob")))
    letters = F.array(*[F.lit(c) for c in fixed.LETTERS[:10]])
    rows = t.embeddings.select("vec_id", maths.token_mass(tokens).alias("seen"))
    return rows.select("vec_id", F.posexplode(maths.letter_probs(F.col("seen"), letters, 1.5)).alias("pos", "prob")).select(
        "vec_id", F.col("pos").cast("bigint").alias("pos"), F.round("prob", 6).alias("prob"))


@query("soft_targets", f"""WITH {PREDS}, s AS (SELECT *, list_transform(probs, lambda p: power(greatest(p, 1e-6), 1 / 2.0)) AS q FROM pr)
    SELECT vec_id, i - 1 AS pos, round(0.7 * q[i] / list_sum(q) + CASE WHEN i = gold_pos THEN 0.3 ELSE 0 END, 6) AS target FROM s, range(1, 11) r(i)""")
def soft_targets(t):
    target = maths.soft_target(F.col("gold_pos"), F.col("probs"), 0.7, 2.0)
    return scored(t).select("vec_id", F.posexplode(target).alias("pos", "target")).select(
        "vec_id", F.col("pos").cast("bigint").alias("pos"), F.round("target", 6).alias("target"))


@query("latency_summary", """WITH o AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS rn,
        count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
    SELECT event_type, n, round(any_value(p50), 6) AS p50_ms, max(value) FILTER (rn = floor(0.95 * (n - 1)) + 1) AS p95_ms, round(any_value(thr), 6) AS throughput_per_s
    FROM o JOIN (SELECT event_type, median(value) AS p50, count(value) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6) AS thr FROM events WHERE value IS NOT NULL GROUP BY 1) USING (event_type)
    GROUP BY event_type, n""")
def latency_summary(t):
    return metrics.latency_summary(t.events, ["event_type"], "value", "ts", "ts").withColumn("p50_ms", F.round("p50_ms", 6)).withColumn(
        "throughput_per_s", F.round("throughput_per_s", 6))


@query("order_price_ranks", """WITH o AS (SELECT o_orderpriority, o_totalprice AS v, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) AS rn,
        count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)
    SELECT o_orderpriority, n, max(v) FILTER (rn = 1) AS lowest, max(v) FILTER (rn = floor(0.95 * (n - 1)) + 1) AS p95, max(v) FILTER (rn = n) AS highest FROM o GROUP BY ALL""")
def order_price_ranks(t):
    return order_statistics(t.orders, ["o_orderpriority"], "o_totalprice", {
        "lowest": F.lit(1), "p95": F.floor(F.lit(0.95) * (F.col("n") - 1)) + 1, "highest": F.col("n")})


@query("cost_per_million", f"""SELECT event_type, round({fixed.GPU_HOURLY} * 1e6 / 3600 / (count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6)), 4) AS cost_per_million
    FROM events GROUP BY event_type""")
def cost_per_million(t):
    busy = F.max(metrics.seconds_of(F.col("ts"))) - F.min(metrics.seconds_of(F.col("ts")))
    return t.events.groupBy("event_type").agg(F.round(metrics.cost_per_million(F.count(F.lit(1)) / busy), 4).alias("cost_per_million"))


@query("language_summary", f"""WITH {PREDS}, l AS (SELECT lang, avg(CAST(correct AS DOUBLE)) AS acc FROM scored GROUP BY lang)
    SELECT round(avg(acc), 6) AS mean, round(max(acc) FILTER (lang = 'en'), 6) AS english, count(*) AS languages,
        count(*) FILTER (acc >= (SELECT acc FROM l WHERE lang = 'en') - 0.10) AS "within" FROM l""")
def language_summary(t):
    return metrics.language_summary(scored(t)).withColumn("mean", F.round("mean", 6)).withColumn("english", F.round("english", 6))


@query("priority_language_mean", f"""WITH {PREDS}, l AS (SELECT lang, avg(CAST(correct AS DOUBLE)) AS acc FROM scored WHERE lang IN ('de', 'fr', 'es') GROUP BY lang)
    SELECT round(avg(acc), 6) AS mean, count(*) AS languages FROM l""")
def priority_language_mean(t):
    return metrics.mean_over(scored(t), ["de", "fr", "es"]).withColumn("mean", F.round("mean", 6))


def _runs(t):
    """Every user is a benchmark, every third day a run: complete unless the last event of the run failed."""
    e = t.events.withColumn("run_ord", (F.unix_date(F.to_date("ts")) % 3).cast("int"))
    return e.groupBy(F.col("user_id").alias("bench_id"), "run_ord").agg(
        F.max_by("event_type", F.struct("ts", "event_id")).alias("last"), F.avg("value").alias("v"), F.count(F.lit(1)).alias("n")).select(
        "bench_id", "run_ord", F.get(F.array(F.lit("choice"), F.lit("noul"), F.lit("score")), (F.col("bench_id") % 3).cast("int")).alias("task"),
        F.concat(F.lit("set_"), (F.col("bench_id") % 11).cast("string")).alias("dataset"),
        F.when(F.col("last") == "error", "failed").otherwise("complete").alias("status"),
        F.when(F.col("bench_id") % 17 != 0, F.col("v") / 100).alias("score"))


RUNS = """e AS (SELECT *, datediff('day', DATE '1970-01-01', CAST(ts AS DATE)) % 3 AS run_ord FROM events),
    runs AS (SELECT user_id AS bench_id, run_ord, ['choice', 'noul', 'score'][user_id % 3 + 1] AS task, 'set_' || (user_id % 11) AS dataset,
        CASE WHEN arg_max(event_type, (ts, event_id)) = 'error' THEN 'failed' ELSE 'complete' END AS status,
        CASE WHEN user_id % 17 <> 0 THEN avg(value) / 100 END AS score FROM e GROUP BY user_id, run_ord),
    merged AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY bench_id ORDER BY CASE WHEN status = 'complete' THEN run_ord ELSE 1000 - run_ord END) AS pick FROM runs) WHERE pick = 1)"""


@query("merged_runs", f"WITH {RUNS} SELECT bench_id, task, dataset, status, round(score, 6) AS score FROM merged")
def merged_runs(t):
    return metrics.merge_runs(_runs(t)).withColumn("score", F.round("score", 6))


AVERAGE = """per AS (SELECT task, round(avg(score) * 100, 2) AS s, count(score) AS n, bool_and(status = 'complete') AS ok FROM kept GROUP BY task)
    SELECT max(s) FILTER (task = 'choice') AS choice, max(s) FILTER (task = 'noul') AS noul, max(s) FILTER (task = 'score') AS score, CAST(sum(n) AS BIGINT) AS benchmarks,
        bool_and(ok) AND count(s) = 3 AS complete, CASE WHEN bool_and(ok) AND count(s) = 3 THEN round(avg(s), 2) END AS task_average FROM per"""


@query("task_average", f"WITH {RUNS}, kept AS (SELECT * FROM merged), {AVERAGE}")
def task_average(t):
    return metrics.task_average(metrics.merge_runs(_runs(t)), ["choice", "noul", "score"])


@query("complete_task_average", f"WITH {RUNS}, kept AS (SELECT * FROM merged WHERE status = 'complete'), {AVERAGE}")
def complete_task_average(t):
    return metrics.task_average(metrics.merge_runs(_runs(t)).filter("status = 'complete'"), ["choice", "noul", "score"])


@query("clean_task_average", f"""WITH {RUNS}, flagged AS (SELECT DISTINCT 'set_' || (o_orderkey % 11) AS dataset FROM orders WHERE o_orderkey % 11 IN (2, 5)),
    kept AS (SELECT * FROM merged ANTI JOIN flagged USING (dataset) WHERE status = 'complete'), {AVERAGE}""")
def clean_task_average(t):
    flagged = t.orders.filter((F.col("o_orderkey") % 11).isin(2, 5)).select(F.concat(F.lit("set_"), (F.col("o_orderkey") % 11).cast("string")).alias("dataset"))
    return metrics.task_average(metrics.merge_runs(_runs(t)).filter("status = 'complete'"), ["choice", "noul", "score"], flagged)


def _judged(t):
    return t.labels.join(t.documents.select("doc_id", "lang", "n_chars"), "doc_id").select(
        "lang", (F.col("quality") == 1).alias("acceptable"), (F.col("toxic") == 1).alias("invents"), (F.col("n_chars") % 2 == 0).alias("answerable"))


JUDGED = "j AS (SELECT d.lang, l.quality = 1 AS acceptable, l.toxic = 1 AS invents, d.n_chars % 2 = 0 AS answerable FROM labels l JOIN documents d USING (doc_id))"


@query("knowledge_rates", f"""WITH {JUDGED} SELECT count(*) AS n, round(avg(CAST(acceptable AS DOUBLE)), 3) AS acceptable,
    round(avg(CAST(acceptable AS DOUBLE)) FILTER (answerable), 3) AS answerable, round(avg(CAST(acceptable AS DOUBLE)) FILTER (NOT answerable), 3) AS unanswerable,
    round(avg(CAST(acceptable AS DOUBLE)) FILTER (lang = 'en'), 3) AS english, round(avg(CAST(acceptable AS DOUBLE)) FILTER (lang <> 'en'), 3) AS other_languages,
    round(avg(CAST(invents AS DOUBLE)), 3) AS invents, round(avg(CAST(invents AS DOUBLE)) FILTER (answerable), 3) AS invents_answerable,
    round(avg(CAST(invents AS DOUBLE)) FILTER (NOT answerable), 3) AS invents_unanswerable FROM j""")
def knowledge_rates(t):
    return metrics.knowledge_rates(_judged(t))


@query("knowledge_rates_by_language", f"""WITH {JUDGED} SELECT lang, round(avg(CAST(acceptable AS DOUBLE)), 3) AS acceptable,
    round(avg(CAST(invents AS DOUBLE)), 3) AS invents, count(*) AS n FROM j GROUP BY lang""")
def knowledge_rates_by_language(t):
    return metrics.knowledge_rates_by_language(_judged(t))


@query("pairwise_win_rate", """WITH v AS (SELECT CASE WHEN event_id % 2 = 0 THEN 1 ELSE 2 END AS ord, CASE event_type WHEN 'click' THEN '1' WHEN 'view' THEN '2' WHEN 'error' THEN '=' ELSE '?' END AS verdict FROM events)
    SELECT count(*) AS judgements, round(avg(CASE verdict WHEN '1' THEN ord - 1 WHEN '2' THEN 2 - ord ELSE 0.5 END), 3) AS b_win_rate FROM v""")
def pairwise_win_rate(t):
    verdict = F.when(F.col("event_type") == "click", "1").when(F.col("event_type") == "view", "2").when(F.col("event_type") == "error", "=").otherwise("?")
    return metrics.win_rate(t.events.select(F.when(F.col("event_id") % 2 == 0, 1).otherwise(2).alias("order"), verdict.alias("verdict")))


@query("accuracy_by_type", """WITH x AS (SELECT ['choice', 'noul', 'score'][user_id % 3 + 1] AS type, event_type = 'error' AS errored, value > 10 AND event_type <> 'error' AS correct FROM events)
    SELECT count(*) AS n, round(avg(CAST(correct AS DOUBLE)) * 100, 1) AS overall,
        round(avg(CAST(correct AS DOUBLE)) FILTER (NOT errored AND type = 'choice') * 100, 1) AS choice,
        round(avg(CAST(correct AS DOUBLE)) FILTER (NOT errored AND type = 'noul') * 100, 1) AS noul,
        round(avg(CAST(correct AS DOUBLE)) FILTER (NOT errored AND type = 'score') * 100, 1) AS score FROM x""")
def accuracy_by_type(t):
    kinds = F.array(F.lit("choice"), F.lit("noul"), F.lit("score"))
    rows = t.events.select(F.get(kinds, (F.col("user_id") % 3).cast("int")).alias("type"), (F.col("event_type") == "error").alias("errored"),
                           ((F.col("value") > 10) & (F.col("event_type") != "error")).alias("correct"))
    return metrics.accuracy_by_type(rows, ["choice", "noul", "score"])


@query("candidate_choice", """WITH s AS (SELECT size, candidate, CASE WHEN candidate % 7 <> 3 OR val <> 1 THEN a END AS acc FROM (
        SELECT n_regionkey AS size, c_nationkey AS candidate, c_custkey % 3 AS val, avg(c_acctbal) AS a FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)),
    m AS (SELECT size, candidate, avg(acc) AS mean FROM s GROUP BY ALL HAVING count(acc) = 3)
    SELECT size, candidate, round(mean, 4) AS mean FROM (SELECT *, row_number() OVER (PARTITION BY size ORDER BY mean DESC, candidate DESC) AS r FROM m) WHERE r = 1""")
def candidate_choice(t):
    val = F.col("c_custkey") % 3
    rows = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(
        F.col("n_regionkey").alias("size"), F.col("c_nationkey").alias("candidate"), val.alias("val")).agg(F.avg("c_acctbal").alias("a"))
    scores = rows.select("size", "candidate", F.when((F.col("candidate") % 7 != 3) | (F.col("val") != 1), F.col("a")).alias("acc"))
    return metrics.choose_candidate(scores).withColumn("mean", F.round("mean", 4))


@query("label_distribution", "SELECT p_type, p_size, count(*) AS n FROM part GROUP BY ALL ORDER BY n DESC, p_type, p_size LIMIT 12")
def label_distribution(t):
    return t.part.groupBy("p_type", "p_size").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "p_type", "p_size").limit(12)


@query("group_counts", "SELECT lang, source, n_chars % 2 = 0 AS answerable, count(*) AS n FROM documents GROUP BY ALL")
def group_counts(t):
    return t.documents.groupBy("lang", "source", (F.col("n_chars") % 2 == 0).alias("answerable")).agg(F.count(F.lit(1)).alias("n"))


@query("token_totals", r"""SELECT conv_id, CAST(sum(len(regexp_extract_all(text, '[^\s]+'))) AS BIGINT) AS input_tokens FROM conversations GROUP BY conv_id""")
def token_totals(t):
    return t.conversations.groupBy("conv_id").agg(F.sum(text.rough_words(F.col("text"))).alias("input_tokens"))


@query("distinct_counts", "SELECT lang, count(DISTINCT text) AS texts, count(DISTINCT source) AS sources FROM documents GROUP BY lang")
def distinct_counts(t):
    """Distinct per language without one task per language: rows are made distinct first, then counted."""
    texts = t.documents.select("lang", F.xxhash64("text").alias("h1"), F.md5("text").alias("h2")).distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("texts"))
    sources = t.documents.select("lang", "source").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("sources"))
    return texts.join(sources, "lang")


BOARD = """board AS (SELECT 'customer ' || c_custkey AS system, c_acctbal AS score FROM customer UNION ALL SELECT 'supplier ' || s_suppkey, s_acctbal FROM supplier)"""


@query("leaderboard", f"WITH {BOARD} SELECT system, score, rank() OVER (ORDER BY score DESC) AS rank FROM board")
def leaderboard(t):
    local = t.customer.select(F.concat(F.lit("customer "), F.col("c_custkey").cast("string")).alias("system"), F.col("c_acctbal").alias("score"))
    published = t.supplier.select(F.concat(F.lit("supplier "), F.col("s_suppkey").cast("string")).alias("system"), F.col("s_acctbal").alias("score"))
    return metrics.leaderboard(local, published).select("system", "score", "rank")


@query("strict_pair", """WITH d AS (SELECT l_orderkey, l_linenumber, l_discount > 0.05 AS bad FROM lineitem), s AS (SELECT l_orderkey, l_linenumber, l_tax > 0.05 AS bad FROM lineitem)
    SELECT count(*) AS n, round(avg(CAST(d.bad AS DOUBLE)), 6) AS draft, round(avg(CAST(s.bad AS DOUBLE)), 6) AS strict FROM d JOIN s USING (l_orderkey, l_linenumber)""")
def strict_pair(t):
    """The same questions judged in two variants, joined on their id."""
    key = ["l_orderkey", "l_linenumber"]
    draft = t.lineitem.select(*key, (F.col("l_discount") > 0.05).alias("draft"))
    strict = t.lineitem.select(*key, (F.col("l_tax") > 0.05).alias("strict"))
    return draft.join(strict, key).agg(F.count(F.lit(1)).alias("n"), F.round(metrics.share(F.col("draft")), 6).alias("draft"),
                                       F.round(metrics.share(F.col("strict")), 6).alias("strict"))


@query("headline_metrics", """WITH r AS (SELECT p_partkey, ['mmlu', 'arc_challenge', 'ifeval', 'mmlu_law', 'gsm8k'][p_partkey % 5 + 1] AS task,
        ['acc', 'acc_norm', 'prompt_level_strict_acc', 'inst_level_strict_acc'][p_size % 4 + 1] AS metric, p_retailprice AS value FROM part)
    SELECT CASE WHEN task = 'ifeval' THEN task || ':' || metric ELSE task END AS label, count(*) AS n, round(avg(value), 4) AS value FROM r
    WHERE (task, metric) IN (('mmlu', 'acc'), ('arc_challenge', 'acc_norm'), ('ifeval', 'prompt_level_strict_acc'), ('ifeval', 'inst_level_strict_acc')) GROUP BY 1""")
def headline_metrics(t):
    tasks, names = ["mmlu", "arc_challenge", "ifeval", "mmlu_law", "gsm8k"], ["acc", "acc_norm", "prompt_level_strict_acc", "inst_level_strict_acc"]
    rows = t.part.select(F.get(F.array(*[F.lit(x) for x in tasks]), (F.col("p_partkey") % 5).cast("int")).alias("task"),
                         F.get(F.array(*[F.lit(x) for x in names]), (F.col("p_size") % 4).cast("int")).alias("metric"), F.col("p_retailprice").alias("value"))
    return metrics.headline(rows).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 4).alias("value"))


@query("parameter_counts", r"""WITH n AS (SELECT p_partkey, p_brand || [' 0.8B', ' E2B', ' 421M', '-9b model', ''][p_partkey % 5 + 1] AS name FROM part)
    SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 0.8 WHEN 2 THEN 0.421 WHEN 3 THEN 9.0 END::DOUBLE AS billions FROM n""")
def parameter_counts(t):
    tail = F.get(F.array(*[F.lit(x) for x in (" 0.8B", " E2B", " 421M", "-9b model", "")]), (F.col("p_partkey") % 5).cast("int"))
    return t.part.select("p_partkey", F.round(text.parameter_billions(F.concat("p_brand", tail)), 6).alias("billions"))


@query("parsed_figures", """SELECT o_orderkey, round(o_orderkey % 1000 / 10, 1) AS share, o_totalprice AS cost, CAST(o_orderkey * 7 AS DOUBLE) AS millis FROM orders""")
def parsed_figures(t):
    """Percentages, amounts and durations written out as a report shows them, then read back."""
    pct = F.concat((F.col("o_orderkey") % 1000 / 10).cast("decimal(10,1)").cast("string"), F.lit("% of all"))
    money = F.concat(F.lit("$"), F.format_number("o_totalprice", 2))
    ms = F.concat(F.format_number(F.col("o_orderkey") * 7, 0), F.lit(" ms"))
    return t.orders.select("o_orderkey", text.percent_value(pct).alias("share"), text.money_value(money).alias("cost"), text.millis_value(ms).alias("millis"))


SUMMARY = f"""WITH {PREDS}, b AS (SELECT bin, count(*) AS n, abs(avg(top) - avg(CAST(correct AS DOUBLE))) AS gap FROM scored GROUP BY bin),
    o AS (SELECT avg(CAST(correct AS DOUBLE)) AS accuracy, avg(-ln(greatest(p_gold, 1e-9))) AS nll, avg(list_sum(list_transform(probs, lambda p: p * p)) - 2 * p_gold + 1) AS brier,
        avg(CAST(correct AS DOUBLE)) FILTER (top >= 0.9) AS selective_accuracy, avg(CAST(top >= 0.9 AS DOUBLE)) AS coverage FROM scored),
    rows AS (SELECT 'summary' AS section, 'run' AS system, metric, value FROM (UNPIVOT o ON COLUMNS(*) INTO NAME metric VALUE value)
        UNION ALL SELECT 'summary', 'run', 'ece', sum(n * gap) / sum(n) FROM b
        UNION ALL SELECT 'family', 'run', family, avg(CAST(correct AS DOUBLE)) FROM scored GROUP BY family)"""


@query("evaluation_metrics", SUMMARY + " SELECT section, system, metric, round(value, 6) AS value FROM rows")
def evaluation_metrics(t):
    return metrics.evaluate(predictions(t).withColumn("probs", maths.softmax(F.col("logits")))).withColumn("value", F.round("value", 6))


@query("full_report", SUMMARY + f""", {JUDGED}, lat AS (SELECT event_type, count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6) AS thr FROM events GROUP BY 1)
    SELECT section, system, metric, round(value, 6) AS value FROM rows
    UNION ALL SELECT 'knowledge', lang, 'acceptable', round(avg(CAST(acceptable AS DOUBLE)), 3) FROM j GROUP BY lang
    UNION ALL SELECT 'knowledge', lang, 'invents', round(avg(CAST(invents AS DOUBLE)), 3) FROM j GROUP BY lang
    UNION ALL SELECT 'cost', event_type, 'throughput_per_s', round(thr, 6) FROM lat
    UNION ALL SELECT 'cost', event_type, 'cost_per_million', round({fixed.GPU_HOURLY} * 1e6 / 3600 / thr, 6) FROM lat""")
def full_report(t):
    """One flat report table from several result families."""
    busy = F.max(metrics.seconds_of(F.col("ts"))) - F.min(metrics.seconds_of(F.col("ts")))
    speed = t.events.groupBy("event_type").agg((F.count(F.lit(1)) / busy).alias("throughput_per_s"))
    speed = speed.withColumn("cost_per_million", metrics.cost_per_million(F.col("throughput_per_s")))
    return metrics.report(
        metrics.evaluate(predictions(t).withColumn("probs", maths.softmax(F.col("logits")))),
        metrics.metric_rows("knowledge", metrics.knowledge_rates_by_language(_judged(t)), F.col("lang"), ["acceptable", "invents"]),
        metrics.metric_rows("cost", speed, F.col("event_type"), ["throughput_per_s", "cost_per_million"])).withColumn("value", F.round("value", 6))


@query("hashed_draws", f"""SELECT c_custkey, round({sql_unit('c_custkey', seed='7', salt='draw')}, 9) AS u,
    CASE WHEN list_reduce(list_transform(string_split(sha1('t' || c_custkey), ''), lambda c: strpos('0123456789abcdef', c) - 1), lambda a, d: (a * 16 + d) % 100) < 5 THEN 'val' ELSE 'train' END AS split
    FROM customer""")
def hashed_draws(t):
    tid = F.concat(F.lit("t"), F.col("c_custkey").cast("string"))
    return t.customer.select("c_custkey", F.round(draws.unit(7, F.col("c_custkey"), salt="draw"), 9).alias("u"), draws.split_of(tid).alias("split"))
