"""What round 3 found, each on rows of its own."""

import random
from collections import Counter
from math import log1p

from pyspark.sql import functions as F

from plumbline.functions import dates, draws
from plumbline.operators import curation, leakage, metrics, model_runs, retrieval


def test_near_copies_equal_all_pairs(spark):
    """Copies, repeated and null ids, texts that share a frequent phrase, and sets near the threshold."""
    r = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    base = [r.choices(words, k=r.randint(3, 60)) for _ in range(40)]
    cut = lambda w: [x if r.random() > 0.12 else r.choice(words) for x in w]
    bench = [" ".join(b + ["all", "of", "them", "say", "this"]) for b in base] * 2
    rows = [(i, " ".join(cut(r.choice(base)) + ["all", "of", "them", "say", "this"])) for i in range(150)]
    rows += [(7, rows[9][1]), (None, rows[3][1]), (900, "w1 w2"), (901, ""), (902, None), (903, bench[0].upper())]
    grams = lambda t: {tuple(w[i:i + 3]) for w in [(t or "").lower().split()] for i in range(len(w) - 2)}
    want = {}
    for i, t in rows:
        for b in set(bench):
            x, y = grams(t), grams(b)
            if x and y and (j := len(x & y) / len(x | y)) >= 0.5:
                want[i] = max(want.get(i, 0), j)
    texts, other = spark.createDataFrame(rows, "id long, text string"), spark.createDataFrame([(b,) for b in bench], "text string")
    got = leakage.near_copies(texts, other, "id", 3, 0.5)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan  # before, every prefix row held its set's shingles once more
    found = {x["id"]: x["jaccard"] for x in got.collect()}
    assert want and found.keys() == want.keys() and all(abs(found[k] - v) < 1e-9 for k, v in want.items())


def test_bootstrap_draws_a_weight_for_every_row(spark):
    rows = spark.range(300).select(F.col("id").alias("k"), (F.col("id") % 3 > 0).alias("correct"))
    low, high = metrics.bootstrap_interval(rows, "k", repeats=50).first()
    other = metrics.bootstrap_interval(rows.withColumn("k", F.col("k") + 1000), "k", repeats=50).first()
    assert low < 2 / 3 < high and (low, high) != tuple(other)  # the draws are the rows' own, not their counts'


def test_facts_are_found_once_and_as_before(spark):
    texts = ["On 2024-02-30 and 2024-02-28, then 2024-03-01.", "Part 1 shipped 2024-01-05. Part 2 shipped 2024-01-09. 5 may 2024", "on 3 SEPTIEMBRE 2024 and 2024-09-01",
             "2024年5月6日, 2024-05-07", "5월 6일 and 2024-05-07", "March 3 and 2024-03-05", "٢ مارس 2024 after 2024-03-01", "20٢٤-03-01 and 2024-03-03", "no date", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    merged = dates.mentions_sql("t").replace("IF(t RLIKE r'" + dates.fixed.MONTH_HINT + "',", "IF(true,")
    for x in df.select("t", dates.find_dates(F.col("t")).alias("a"), F.expr(merged).alias("b"), dates.date_facts(F.col("t")).alias("f")).collect():
        assert (x["a"] or []) == (x["b"] or []), x["t"]
    from plumbline.plans.date_queries import facts_once
    rows = facts_once(df.withColumnRenamed("id", "o_orderkey"), dates.date_facts(F.col("t"))).filter(F.size("f") > 0)
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("flatten") == 1
    many = " ".join(f"2024-01-{d:02d}" for d in range(1, 10))
    one = spark.createDataFrame([(many,)], "t string").select(dates.date_facts(F.col("t")).alias("f")).first()["f"]
    assert len(one) == 6 and one[0] == "2024-01-02 is 1 day after 2024-01-01" and one[5] == "2024-01-07 is 6 days after 2024-01-01"


def test_a_stored_pool_is_written_without_a_shuffle(spark):
    pool = spark.createDataFrame([(f"a{i} b c d e f",) for i in range(50)], "text string").repartition(5)
    stored = leakage.store_pool(pool, 3, buckets=8)
    assert stored.count() == 50 * 5 and stored.distinct().count() == 50 * 2 + 3
    assert len(stored.inputFiles()) > 8  # every task wrote its own files


def test_weighted_join_draws_as_running_sums_do(spark):
    r = random.Random(2)
    weights = [(f"n{i:03d}", r.choice([0.0, 0.1, 1.0, 3.7, 20.0])) for i in range(150)]
    dim = spark.createDataFrame(weights, "name string, weight double")
    rows = spark.range(3000)
    got = {x["id"]: x["name"] for x in curation.weighted_join(rows, dim, "weight", draws.unit(1, F.col("id"))).collect()}
    total = 0.0
    for _, w in sorted(weights):
        total += w
    for x in rows.select("id", draws.unit(1, F.col("id")).alias("u")).collect():
        run = at = 0
        for _, w in sorted(weights):
            run += w
            at += run <= x["u"] * total
        assert got[x["id"]] == sorted(weights)[min(at, 149)][0]
    assert curation.weighted_join(rows, dim.limit(0), "weight", draws.unit(1, F.col("id"))).where("name is not null").count() == 0


def test_labelling_deals_templates_so_that_no_task_holds_many(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(model_runs, "TEMPLATES_A_TASK", 10, raising=False)
    option = lambda k: F.struct(F.lit(k).alias("key"), F.lit("what").alias("description"))
    empty = F.lit(None).cast("map<string,double>")
    pairs = F.array(F.struct(F.lit("x").alias("a"), F.lit("y").alias("b"), empty.alias("teacher_a"), empty.alias("teacher_b")))
    examples = F.array(F.struct(F.lit("x").alias("state"), F.lit("k0").alias("gold")))
    templates = spark.range(200).coalesce(1).select(F.concat(F.lit("t"), F.col("id").cast("string")).alias("tid"), F.lit("Which?").alias("question"),
                                                    F.array(option("k0"), option("k1")).alias("options"), examples.alias("examples"), pairs.alias("pairs"))
    seen = []

    def call(rows):
        seen.append(rows.rdd.getNumPartitions())
        return rows.withColumn("error", F.lit(None).cast("string")).withColumn("seen", F.create_map(F.lit("A"), F.lit(0.75), F.lit("B"), F.lit(0.25)))

    done = model_runs.label(templates, call, str(tmp_path / "labels"), batches=2)
    assert {(x["tid"], x["pairs"][0]["teacher_a"]["k0"]) for x in done.collect()} == {(f"t{i}", 0.75) for i in range(200)}
    assert max(seen) >= 20
    assert "SortMergeJoin" in done._jdf.queryExecution().executedPlan().toString()


def test_search_writes_no_row_for_every_query_and_passage(spark, monkeypatch):
    """Blocks of a few passages, equal scores across them, keys of two columns: as brute force, and few rows are written."""
    monkeypatch.setattr(retrieval, "BLOCK", 16, raising=False)
    r = random.Random(8)
    words = [f"word{i}x" for i in range(12)]
    texts = [r.choices(words, k=r.randint(1, 8)) for _ in range(120)]
    texts += texts[:40]
    keys = [(f"d{i % 50:02d}", i) for i in range(160)]
    asked = [r.sample(words, r.randint(1, 5)) for _ in range(80)]
    table = spark.createDataFrame([("c", d, n, " ".join(t)) for (d, n), t in zip(keys, texts)], "corpus string, doc string, n int, text string")
    queries = spark.createDataFrame([(q, "c", " ".join(w)) for q, w in enumerate(asked)], "q long, corpus string, query string")
    indexed, written, plain = retrieval.write_index(table, "corpus", ["doc", "n"]), {}, retrieval.materialise

    def counted(df, label):
        done = plain(df, label)
        written[label] = done.count()
        return done

    monkeypatch.setattr(retrieval, "materialise", counted)
    found = retrieval.search(queries, indexed, "q", 4).collect()
    df, mean = Counter(w for t in texts for w in set(t)), sum(map(len, texts)) / len(texts)
    for q, w in enumerate(asked):
        score = [round(sum(log1p((160 - df[x] + 0.5) / (df[x] + 0.5)) * t.count(x) * 2.2 / (t.count(x) + 1.2 * (0.25 + 0.75 * len(t) / mean)) for x in w), 9) for t in texts]
        best = sorted((i for i in range(160) if score[i]), key=lambda i: (-score[i], keys[i]))[:4]
        want = [(k + 1, keys[i], score[i]) for k, i in enumerate(best)]
        got = sorted((x["rank"], (x["doc"], x["n"]), x["score"]) for x in found if x["q"] == q)
        assert [x[:2] for x in got] == [x[:2] for x in want] and all(abs(x[2] - y[2]) < 1e-8 for x, y in zip(got, want)), w
    assert written and max(written.values()) <= 80 * 4 * 10  # 80 queries, 4 passages of each of 10 blocks; before, some 7,000 pairs
