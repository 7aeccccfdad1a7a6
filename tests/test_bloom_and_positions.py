"""The Bloom filter, stored pools and dense positions."""

import random

import pytest
from pyspark.sql import functions as F

from plumbline.functions import text
from plumbline.operators import bloom, leakage, ranking


@pytest.mark.parametrize("bits", [1 << 10, 1 << 16])
def test_bloom_filters_lose_nothing(spark, bits):
    held = spark.range(1000).select(F.xxhash64("id").alias("h"))
    asked = spark.range(20_000).select("id", F.xxhash64("id").alias("h"))
    passed = {r["id"] for r in asked.where(bloom.may_hold(held, "h", bits)(F.col("h"))).collect()}
    assert passed >= set(range(1000))
    if bits > 1 << 12:
        assert len(passed) < 1200
    empty = held.where("h is null")
    assert asked.where(bloom.may_hold(empty, "h", bits)(F.col("h"))).count() == 0


def test_stored_pools_give_the_same_hits_without_moving_the_pool(spark):
    r = random.Random(3)
    words = [f"w{i}" for i in range(12)]
    line = lambda k: " ".join(r.choices(words, k=k))
    pool = spark.createDataFrame([(line(r.randint(0, 30)),) for _ in range(200)] + [("the same text again",)] * 100, "text string")
    items = spark.createDataFrame([("s", str(i), line(r.randint(1, 20))) for i in range(60)] + [("s", "60", "The same text, again"), ("s", "61", "")], "eval_set string, item_id string, text string")
    stored = leakage.store_pool(pool, 3, buckets=16)
    want = {tuple(x) for x in leakage.shingle_hits(pool, items, 3).collect()}
    assert {tuple(x) for x in leakage.hits_in(stored, items, 3).collect()} == want
    assert {tuple(x) for x in leakage.shingle_hits(pool, items, 3, large_pool=False).collect()} == want
    grams = lambda t: {tuple(t.lower().replace(",", "").split()[i:i + 3]) for i in range(len(t.split()) - 2)}
    known = set().union(*(grams(x["text"]) for x in pool.collect()))
    assert {(x["item_id"], len(grams(x["text"])), len(grams(x["text"]) & known)) for x in items.collect() if x["text"]} == {(i, g, n) for _, i, g, n, _ in want}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = leakage.hits_in(stored, items, 3)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = plan.split("\n")
    scan = next(i for i, x in enumerate(lines) if "FileScan" in x and "Bucketed: true" in x)
    assert not any("Exchange" in x for x in lines[scan - 3:scan]), plan


def test_positions_are_dense_in_order(spark):
    r = random.Random(4)
    data = [(i, r.choice(["a", "b", None]), r.randrange(50)) for i in range(3000)] + [(5000 + i, "hot", 7) for i in range(2000)]
    df = spark.createDataFrame(data, "id long, g string, v long").repartition(7)
    whole = ranking.positions(df, ["v", "id"]).collect()
    assert [x["id"] for x in sorted(whole, key=lambda x: x["position"])] == [i for i, *_ in sorted(data, key=lambda x: (x[2], x[0]))]
    assert sorted(x["position"] for x in whole) == list(range(5000))
    got = ranking.positions(df, [F.desc("v"), "id"], "at", ["g"]).collect()
    for g in ("a", "b", None, "hot"):
        own = sorted((x for x in got if x["g"] == g), key=lambda x: x["at"])
        assert [x["at"] for x in own] == list(range(len(own))) and [x["id"] for x in own] == [i for i, *_ in sorted((d for d in data if d[1] == g), key=lambda d: (-d[2], d[0]))]
    assert ranking.positions(df.limit(0), ["v"]).count() == 0


def test_small_tables_are_spread_without_a_job(spark):
    from plumbline.session import spread
    df = spark.range(10).repartition(1).select(F.concat_ws(" ", "id", "id").alias("text"))
    assert spread(df).select(text.words(F.col("text")).alias("w")).count() == 10
