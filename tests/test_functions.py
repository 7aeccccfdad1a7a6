import datetime
import hashlib

from pyspark.sql import functions as F

from plumbline.functions import dates, draws, maths, prompts, text


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def facts(spark, body):
    return one(spark, dates.date_facts(F.col("t")), t=body)


def test_hash_split_is_the_whole_digest_modulo_100_in_any_partitioning(spark):
    ids = [f"s1-{i:06d}" for i in range(200)]
    want = {i: int(hashlib.sha1(i.encode()).hexdigest(), 16) % 100 for i in ids}
    df = spark.createDataFrame([(i,) for i in ids], ["tid"])
    for parts in (1, 4, 64):
        rows = df.repartition(parts).select("tid", draws.hash_bucket(F.col("tid")).alias("b")).collect()
        assert {r["tid"]: r["b"] for r in rows} == want


def test_draws_are_uniform_and_stable(spark):
    df = spark.range(20000)
    for parts in (1, 64):
        r = df.repartition(parts).agg(F.avg(draws.unit(1, F.col("id"))).alias("m"), F.sum(F.hash(draws.unit(1, F.col("id"))).cast("bigint")).alias("h")).first()
        assert abs(r["m"] - 0.5) < 0.01
        first = r["h"] if parts == 1 else first
        assert r["h"] == first
    picked = draws.weighted_choice(draws.unit(2, F.col("id")), ["a", "b"], [3, 1])
    share = df.agg(F.avg((picked == "a").cast("double"))).first()[0]
    assert abs(share - 0.75) < 0.01


def test_shuffle_array_keeps_members(spark):
    got = one(spark, draws.shuffle_array(F.array(*[F.lit(i) for i in range(20)]), 1, F.lit("x"), lambda e: e))
    assert sorted(got) == list(range(20)) and got != list(range(20))


def test_words_norm_and_shingles(spark):
    assert one(spark, text.norm(F.col("t")), t="Hello,  WORLD_1! été") == "hello world_1 été"
    assert one(spark, text.shingles(text.words(F.col("t")), 3), t="a b c d") == [["a", "b", "c"], ["b", "c", "d"]]
    assert one(spark, text.shingles(text.words(F.col("t")), 13), t="too short") == []


def test_retrieval_words_of_many_scripts(spark):
    words = lambda s: one(spark, text.retrieval_words(F.col("t")), t=s)
    assert words("What are the refunds for glass?") == ["refund", "glass"]
    assert words("हिन्दी") == ["हिन्दी"]
    assert words("退货政策") == ["退货", "货政", "政策"]
    assert words("货") == ["货"]


def test_rough_words_and_sentences(spark):
    assert one(spark, text.rough_words(F.col("t")), t="one two three") == 3
    assert one(spark, text.rough_words(F.col("t")), t="退货政策说明") == 3
    assert one(spark, text.sentences(F.col("t")), t="One. Two!\n- item\n\n好。再见。") == ["One.", "Two!", "- item", "好。", "再见。"]


def test_exact_facts_in_one_spelling(spark):
    got = one(spark, text.exact_facts(F.col("t")), t="Mail A.b@x.org. See https://www.x.y/ at 8 PM or 8:00 p.m., pay 1,250.00 or 1250, not 42; 1,234,567.50")
    assert sorted(got) == sorted(["a.b@x.org", "x.y", "8:00pm", "1250", "1234567.5"])
    assert one(spark, text.unmatched_facts(F.col("s"), F.col("k")), s="It is 300 or 400 at 9am", k="300 and 9:00 AM") == ["400"]


def test_small_text_functions(spark):
    assert one(spark, text.strip_letter(F.col("t")), t="(A).\nBecause.") == "Because."
    assert one(spark, text.strip_letter(F.col("t")), t=" B") == ""
    assert one(spark, text.strip_letter(F.col("t")), t="All of it\nBecause.") == "All of it\nBecause."
    assert one(spark, text.keeps_numbers(F.lit("12 of 30"), F.lit("30 mal 12"))) is True
    assert one(spark, text.keeps_numbers(F.lit("12 of 30"), F.lit("३० mal 12"))) is False
    assert one(spark, text.fill("{a}-{b}-{a}", a=F.lit(1), b=F.lit("{a}"))) == "1-{a}-1"
    assert one(spark, text.parameter_billions(F.lit("Gemma E2B"))) is None
    assert one(spark, text.parameter_billions(F.lit("bert-421M"))) == 0.421
    assert one(spark, text.day_count(F.lit(1))) == "1 day"


def test_date_facts(spark):
    assert facts(spark, "Delivered on 2026-05-01. Return requested on 2026-06-05.") == ["2026-06-05 is 35 days after 2026-05-01"]
    assert facts(spark, "May 1st, 2026 and 2 May 2026") == ["2 May 2026 is 1 day after May 1st, 2026"]
    assert facts(spark, "Due May 1, paid April 30. Printed 2026-01-01.") == [
        "April 30 is 1 day before May 1", "2026-01-01 is 120 days before May 1", "2026-01-01 is 119 days before April 30"]
    assert facts(spark, "Only May 3 here and May 5") == []
    assert facts(spark, "05/01/2026 and 2026-02-30 and 2026-03-01") == []
    assert facts(spark, "Feb 29 and 2025-01-01") == []
    assert facts(spark, "2026-01-02, again 2026-01-02, and 2 January 2026") == ["2 January 2026 is the same day as 2026-01-02"]
    assert facts(spark, "3 de enero de 2026 y 5 de enero") == ["5 de enero is 2 days after 3 de enero de 2026"]
    assert facts(spark, "२ जनवरी २०२६ और ५ जनवरी २०२६") == ["५ जनवरी २०२६ is 3 days after २ जनवरी २०२६"]
    assert facts(spark, "2026年5月1日、5月3日") == ["5月3日 is 2 days after 2026年5月1日"]
    assert len(facts(spark, " ".join(f"2026-01-{d:02d}" for d in range(1, 10)))) == 6
    assert facts(spark, None if False else "no dates") == []


def test_native_iso_path_agrees(spark):
    body = "2026-01-05 to 2026-01-01, then 2026-01-01; bad 2026-13-01, x2026-01-09"
    assert facts(spark, body) == one(spark, dates.date_facts(F.col("t"), True), t=body)


def test_find_dates_offsets(spark):
    got = one(spark, dates.find_dates(F.col("t")), t="On May 1 at 5:00, 2026-05-02")
    assert [(m["pos"], m["surface"], m["date"], m["month"], m["day"]) for m in got] == [
        (3, "May 1", None, 5, 1), (18, "2026-05-02", datetime.date(2026, 5, 2), None, None)]


def test_probability_columns(spark):
    arr = lambda *x: F.array(*[F.lit(v) for v in x])
    assert one(spark, maths.confidence(arr(0.25, 0.25, 0.25, 0.25))) == 0.0
    assert one(spark, maths.confidence(arr(1.0, 0.0))) == 1.0
    assert one(spark, maths.confidence(arr(0.3))) == 1.0
    assert one(spark, maths.first_top(arr(0.2, 0.4, 0.4))) == 2
    assert one(spark, maths.expected_level(arr(0.5, 0.0, 0.5))) == 1.0
    assert [one(spark, maths.bin10(F.lit(p))) for p in (0.0, 0.1, 0.3, 0.7, 0.70001, 1.0)] == [0, 0, 2, 6, 7, 9]
    tokens = F.array(*[F.struct(F.lit(t).alias("token"), F.lit(p).alias("logprob")) for t, p in (("A", -1.0), (" A", -1.0), ("C", -3.0))])
    got = one(spark, maths.letter_probs(maths.token_mass(tokens), F.array(F.lit("A"), F.lit("B"))))
    import math
    a, b = 2 * math.exp(-1), math.exp(-3) / 2
    assert abs(got[0] - a / (a + b)) < 1e-12 and abs(sum(got) - 1) < 1e-12
    assert one(spark, maths.letter_probs(F.create_map().cast("map<string,double>"), F.array(F.lit("A"), F.lit("B")))) == [0.5, 0.5]
    assert [round(x, 6) for x in one(spark, maths.soft_target(F.lit(1), arr(0.2, 0.8), 0.5))] == [0.6, 0.4]
    assert one(spark, maths.hard_target(F.lit(2), F.lit(3))) == [0.0, 1.0, 0.0]
    kept = one(spark, maths.keep_keys(F.create_map(F.lit("a"), F.lit(0.0), F.lit("b"), F.lit(1.0)), F.array(F.lit("a"))))
    assert kept == {"a": 0.0}


def test_prompts(spark):
    opt = lambda k, d: F.struct(F.lit(k).alias("key"), F.lit(d).alias("description"))
    options = F.array(opt("yes", 'say "yes"'), opt("no", "é"))
    shot = F.array(F.struct(prompts.json_string(F.lit("s")).alias("state_json"), F.array(F.lit("f1")).alias("facts"), F.lit("no").alias("gold")))
    none = F.array().cast("array<string>")
    got = one(spark, prompts.decision_body(F.lit("Q?"), options, F.lit('{"b":1,"a":2}'), none, shot))
    assert got == ('{"question":"Q?","options":[{"label":"A","key":"yes","description":"say \\"yes\\""},{"label":"B","key":"no","description":"é"}],'
                   '"examples":[{"state":"s","facts":["f1"],"answer":"B"}],"state":{"b":1,"a":2}}')
    turns = F.array(prompts.message("system", F.lit("Be kind.")), prompts.message("user", F.lit("Hi")))
    grounded = prompts.knowledge_messages(turns, F.array(F.lit("p one"), F.lit("p two")))
    rows = one(spark, grounded)
    assert len(rows) == 2 and rows[0]["content"].startswith("Be kind.\n\nAnswer using only") and rows[0]["content"].endswith("Knowledge:\n[1] p one\n\n[2] p two")
    assert one(spark, prompts.knowledge_of(grounded)) == "[1] p one\n\n[2] p two"
    assert one(spark, prompts.knowledge_of(turns)) is None
    assert one(spark, prompts.summary_messages(F.lit("T"), F.lit("dates")))[0]["content"].endswith(" Focus on: dates.\n\nT")


def test_dates_of_many_languages_and_forms_that_compete(spark):
    def found(body):
        return [(m["pos"], m["surface"], m["date"] and str(m["date"]), m["month"], m["day"]) for m in one(spark, dates.find_dates(F.col("t")), t=body)]

    assert found("am 1. MÄRZ 2026 und 1er août") == [(3, "1. MÄRZ 2026", "2026-03-01", None, None), (20, "1er août", None, 8, 1)]
    assert found("٣ مارس ٢٠٢٦") == [(0, "٣ مارس ٢٠٢٦", "2026-03-03", None, None)]
    assert found("2026년 5월 1일, 3월 2일") == [(0, "2026년 5월 1일", "2026-05-01", None, None), (13, "3월 2일", None, 3, 2)]
    assert found("5 мая 2026, 31 ноября 2026") == [(0, "5 мая 2026", "2026-05-05", None, None)]
    # a form is read with what stands around it, also when that belongs to another mention
    assert found("May 1, 2026-05-02") == [(7, "2026-05-02", "2026-05-02", None, None)]
    assert found("May 12:00 Sept. 3 1 Dec., 2026") == [(10, "Sept. 3", None, 9, 3), (18, "1 Dec., 2026", "2026-12-01", None, None)]
    assert found("3 mars 2150 x2026-01-09 2026-13-01 2026-01-05") == [(36, "2026-01-05", "2026-01-05", None, None)]
    assert found("") == [] and one(spark, dates.find_dates(F.col("t")), t="no digit, March") == []
    assert one(spark, F.size(dates.find_dates(F.col("t"))), t="on 2026-01-02 or May 3, " * 2000) == 4000
