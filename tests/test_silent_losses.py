"""Cases in which rows, options or texts used to get lost without a word."""

import math

import pytest
from pyspark.sql import functions as F

from plumbline.functions import maths, prompts
from plumbline.operators import curation, ranking, scoring
from plumbline.sources import bundle
from test_decisions import wide


def softmax(group):
    return maths.softmax(F.transform(group, lambda o: o["description"].cast("double") / 20))


@pytest.mark.parametrize(("options", "group"), [(513, 8), (217, 6), (8, 8), (65, 8)])
def test_every_option_has_a_probability(spark, options, group):
    probs = scoring.tournament(wide(spark, options), "options", softmax, group=group).first()["probs"]
    assert len(probs) == options and None not in probs and abs(sum(probs) - 1) < 1e-9


def test_more_options_than_promised_end_the_job(spark):
    with pytest.raises(Exception, match="more than 8 options"):
        scoring.tournament(wide(spark, 9), "options", softmax, most=8).collect()


def test_rows_without_a_score_keep_their_place_in_the_table(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", None), ("c", 2.0), ("d", 1.0)], "s string, score double")
    assert {r["s"]: r["rank"] for r in ranking.standings(df, "score").collect()} == {"a": 2, "b": None, "c": 1, "d": 2}


def test_labels_never_repeat(spark):
    r = wide(spark, 60).select(prompts.lettered("options").alias("l"), prompts.letter_of(F.col("options"), F.col("options")[29]["key"]).alias("one"), "options").first()
    labels = [x["label"] for x in r["l"]]
    assert len(set(labels)) == 60 and "" not in labels and labels[:2] == ["A", "B"] and labels[25:28] == ["Z", "AA", "AB"] and r["one"] == labels[29]


def test_empty_headers(spark):
    texts = {"a.md": "---\n---\nText", "b.md": "---\n---\nBody one\n\n---\nRest", "c.md": "---\ntitle: T\n---\nBody\n---\nmore", "d.md": "no header\n---\n", "e.md": "---\nnever closed"}
    got = {r["path"]: r["body"] for r in bundle.parse(spark.createDataFrame(list(texts.items()), "path string, text string")).collect()}
    assert got == {"a.md": "Text", "b.md": "Body one\n\n---\nRest", "c.md": "Body\n---\nmore", "d.md": texts["d.md"], "e.md": texts["e.md"]}


def test_plus_signs_in_file_names(spark, tmp_path):
    (tmp_path / "c++ guide.md").write_text("Text")
    (tmp_path / "a%20b.md").write_text("Text")
    assert {r["path"] for r in bundle.load_bundle(spark, str(tmp_path)).collect()} == {"c++ guide.md", "a%20b.md"}


def test_outside_scorer_sees_its_group_and_errors_stay(spark):
    calls = spark.sparkContext.accumulator(0)

    def make_client():
        def client(rows):
            for row in rows:
                calls.add(1)
                if row["id"] == "n2":
                    raise ValueError("no answer")
                assert 2 <= len(row["options"]) <= 8 and row["prompt"] == ",".join(o["key"] for o in row["options"])
            z = [[math.exp(float(o["description"]) / 20) for o in row["options"]] for row in rows]
            return [{"probs": [x / sum(one) for x in one]} for one in z]
        return client

    tasks = wide(spark, 2, 9, 30).withColumn("id", F.concat(F.lit("n"), F.size("options")))
    render = lambda rows: rows.withColumn("prompt", F.array_join(F.transform("options", lambda o: o["key"]), ","))
    got = {r["id"]: r for r in scoring.tournament_with(tasks.coalesce(1), "id", lambda: make_client(), ["id", "options", "prompt"], render=render).collect()}
    assert got["n2"]["probs"] is None and "no answer" in got["n2"]["error"]
    assert all(abs(sum(got[k]["probs"]) - 1) < 1e-9 and got[k]["error"] is None for k in ("n9", "n30"))


def test_small_tasks_are_asked_once(spark):
    calls = spark.sparkContext.accumulator(0)

    def make_client():
        def client(rows):
            calls.add(len(rows))
            return [{"probs": [1 / len(r["options"])] * len(r["options"])} for r in rows]
        return client

    scoring.tournament_with(wide(spark, 2, 3, 5), "id", make_client, ["options"], most=255).collect()
    assert calls.value == 3


def test_distractors_are_never_fewer_than_asked(spark):
    contexts = spark.createDataFrame([(1, f"own {i}") for i in range(6)] + [(d, f"text {d}") for d in range(2, 6)], "doc long, text string")
    rows = spark.createDataFrame([(r, 1 + r % 5) for r in range(40)], "row long, doc long")
    got = curation.distractors(rows, contexts, "row", "doc", 3).collect()
    assert len(got) == 120 and all(g["other"] != 1 + g["row"] % 5 for g in got)
    assert curation.distractors(rows, contexts.limit(0), "row", "doc", 3).count() == 0
    assert curation.distractors(rows.filter("doc = 1"), contexts, "row", "doc", 9).count() == 8 * 4  # all others
