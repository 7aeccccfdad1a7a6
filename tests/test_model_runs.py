"""Runs around a model: what is written is never asked again, and a run that stopped goes on."""

import pytest
from pyspark.sql import functions as F

from plumbline.functions import fixed
from plumbline.operators import model_runs, scoring, strict


def asked_by(log):
    """A client that writes down what it is asked."""
    def factory():
        def client(rows):
            with open(log, "a") as file:
                for r in rows:
                    file.write(r["messages"][-1]["content"].replace("\n", " ") + "\n")
            return [{"response": f"re: {r['messages'][-1]['content']}", "finish_reason": "stop"} for r in rows]
        return client
    return lambda rows: scoring.generate_with(rows, factory, ["messages"], keep=False)


def prompts_of(spark, names):
    return spark.createDataFrame([(n, [{"role": "user", "content": n}]) for n in names], "id string, messages array<struct<role:string,content:string>>")


def test_a_journal_is_never_asked_twice(spark, tmp_path):
    log, path = str(tmp_path / "log"), str(tmp_path / "journal")
    first = model_runs.distil(prompts_of(spark, ["a", "b", "c"]), "id", asked_by(log), path, batches=3)
    assert {r["id"]: r["response"] for r in first.collect()} == {n: f"re: {n}" for n in "abc"}
    more = model_runs.distil(prompts_of(spark, ["b", "c", "d"]), "id", asked_by(log), path, batches=2)
    assert sorted(r["id"] for r in more.collect()) == ["b", "c", "d"]
    assert sorted(open(log).read().split()) == ["a", "b", "c", "d"]


def test_failed_calls_are_tried_by_the_next_run(spark, tmp_path):
    def flaky():
        def client(rows):
            if any(r["messages"][-1]["content"] == "b" for r in rows):
                raise RuntimeError("no")
            return [{"response": "x", "finish_reason": "length"} for r in rows]
        return client
    path = str(tmp_path / "journal")
    call = lambda rows: scoring.generate_with(rows, flaky, ["messages"], attempts=1, pause=0.0, keep=False)
    assert sorted(r["id"] for r in model_runs.distil(prompts_of(spark, ["a", "b", "c"]), "id", call, path).collect()) == ["a", "c"]
    done = model_runs.distil(prompts_of(spark, ["a", "b", "c"]), "id", asked_by(str(tmp_path / "log")), path).collect()
    assert {r["id"]: r["truncated"] for r in done} == {"a": True, "b": False, "c": True} and open(tmp_path / "log").read().split() == ["b"]


def test_a_dead_service_costs_few_calls(tmp_path):
    calls = []

    def dead(rows):
        calls.append(len(rows))
        raise RuntimeError("down")
    got = scoring._each(dead, [{}] * 5000, 3, 0.0, [scoring.FAILURES])
    assert len(got) == 5000 and all(a is None and "down" in e for a, e in got) and len(calls) < 60
    picky = lambda rows: [{"v": r["i"]} for r in rows] if all(r["i"] != 37 for r in rows) else 1 / 0
    got = scoring._each(picky, [{"i": i} for i in range(100)], 2, 0.0, [scoring.FAILURES])
    assert [a and a["v"] for a, _ in got] == [i if i != 37 else None for i in range(100)] and "ZeroDivision" in got[37][1]


def jobs_of(spark):
    rows = [("k1", "English", None, ["Open nine to five."], [("When?", True), ("Price?", False), ("Where?", True)]),
            ("k2", "German", "Du bist Bot.", ["Offen."], [("Wann?", True)]), ("k3", "English", None, ["x"], [])]
    return spark.createDataFrame(rows, "id string, lang string, system string, passages array<string>, questions array<struct<question:string,answerable:boolean>>")


def test_teacher_chats_go_on_behind_the_last_whole_round(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(model_runs, "CARRY", 1.0)
    seen = []

    def call(rows, fail=None):
        seen.append({r["id"]: [(m["role"], m["content"]) for m in r["messages"]] for r in rows.select("id", "messages").collect()})
        if fail is not None and len(seen) == fail:
            raise KeyboardInterrupt
        said = F.when(F.element_at("messages", -1)["content"] == "Price?", "I don't have that information.").otherwise(F.concat(F.lit("To "), F.element_at("messages", -1)["content"]))
        return rows.withColumns({"response": said, "finish_reason": F.lit("stop"), "error": F.lit(None).cast("string")})
    path = str(tmp_path / "chat")
    with pytest.raises(KeyboardInterrupt):
        model_runs.teacher_chat(jobs_of(spark), lambda rows: call(rows, fail=2), path)
    done = {(r["id"], r["turn"]): r for r in model_runs.teacher_chat(jobs_of(spark), call, path).collect()}
    assert [sorted(s) for s in seen] == [["k1", "k2"], ["k1"], ["k1"], ["k1"]]  # the broken second round once more, the first not
    assert sorted(done) == [("k1", 0), ("k1", 1), ("k1", 2), ("k2", 0)]
    assert seen[0]["k2"][0][1].startswith("Du bist Bot.") and seen[3]["k1"][1:] == [("user", "Price?"), ("assistant", "I don't have that information."), ("user", "Where?")]


def test_an_answer_to_an_unanswerable_question_goes(spark, tmp_path):
    call = lambda rows: rows.withColumns({"response": F.lit("It costs 5."), "finish_reason": F.lit("length"), "error": F.lit(None).cast("string")})
    done = model_runs.teacher_chat(jobs_of(spark), call, str(tmp_path / "chat")).collect()
    assert sorted((r["id"], r["turn"], r["truncated"]) for r in done) == [("k1", 0, True), ("k1", 2, True), ("k2", 0, True)]


def test_labels_go_into_both_halves_or_nowhere(spark, tmp_path):
    option = [{"key": "yes", "description": "d"}, {"key": "no", "description": "d"}]
    pair = lambda a, b: {"a": a, "b": b, "teacher_a": None, "teacher_b": None}
    rows = [("t1", "Q?", option, [{"state": "s", "gold": "no"}], [pair("x1", "x2"), pair("x3", "x4")]), ("t2", "Q?", [{"key": f"k{i}", "description": "d"} for i in range(10)], [], [pair("bad", "x5")])]
    made = spark.createDataFrame(rows, "tid string, question string, options array<struct<key:string,description:string>>, examples array<struct<state:string,gold:string>>, "
                                       "pairs array<struct<a:string,b:string,teacher_a:map<string,double>,teacher_b:map<string,double>>>")
    shown = {(r["tid"], r["state"]): len(r["messages"]) for r in model_runs.label_rows(made).collect()}
    assert shown["t1", "x1"] == 4 and shown["t2", "bad"] == 2  # one worked example; none behind eight options

    def call(rows):
        seen = F.create_map(F.lit("A"), F.when(F.col("state") == "x2", 0.2).otherwise(0.6), F.lit("B"), F.lit(0.2))
        error = F.when(F.col("state") == "bad", F.lit("busy"))
        return rows.withColumn("error", error).withColumn("seen", F.when(error.isNull(), seen))
    path = str(tmp_path / "labels")
    done = model_runs.label(made, call, path).collect()
    assert [r["tid"] for r in done] == ["t1"]
    assert [{k: round(v, 6) for k, v in p["teacher_a"].items()} for p in done[0]["pairs"]] == [{"yes": 0.75, "no": 0.25}] * 2 and done[0]["pairs"][0]["teacher_b"]["yes"] == 0.5
    assert sorted(r["tid"] for r in model_runs.label(made.where("tid = 't1'"), lambda rows: 1 / 0 if rows.head() else call(rows), path).collect()) == ["t1"]


def test_templates_keep_braces_of_their_parts(spark):
    row = spark.range(1).select(model_runs.filled("a {x} b {y}", x=F.lit("{y}"), y=F.lit("{x}")).alias("t")).first()
    assert row["t"] == "a {y} b {x}"
    assert [model_runs.yes(F.lit(x)) is not None for x in ("Yes", "no")]


def test_reply_check_asks_for_claims_of_facts_only(spark):
    asked = []

    def ask(rows, state, question, kind, options):
        got = [r[state] for r in rows.select(state).collect()]
        asked.append((question, sorted(got)))
        c = F.col(state)
        if question == fixed.SENTENCE_KIND_QUESTION:
            return rows.withColumn("probs", F.when(c.contains("Hello"), F.array(F.lit(0.1), F.lit(0.1), F.lit(0.8))).otherwise(F.array(F.lit(0.8), F.lit(0.1), F.lit(0.1))))
        return rows.withColumn("probs", F.when(c.endswith("red."), F.array(F.lit(0.9), F.lit(0.05), F.lit(0.05))).otherwise(F.array(F.lit(0.2), F.lit(0.4), F.lit(0.4))))
    rows = spark.createDataFrame([("r", "Hello you. It is red. It is blue. Call 5550100. My order is 12345.", "A car.", ["order 12345"])], "id string, draft string, knowledge string, users array<string>")
    done, report = strict.verify(rows, "id", ask)
    assert asked[0][1] == sorted(f"Sentence: {s}" for s in ["Hello you.", "It is red.", "It is blue.", "Call 5550100.", "My order is 12345."])
    got = {r["sentence"]: (r["kind"], r["supported"]) for r in report.collect()}
    claims = sorted(f"Evidence:\nA car.\n\nClaim: {s}" for s in ["It is red.", "It is blue.", "My order is 12345."])
    assert all(a[1] == claims for a in asked[1:]) and len(asked) > 1  # the user's own words are no evidence
    assert got == {"Hello you.": ("other", None), "It is red.": ("fact", 0.9), "It is blue.": ("fact", 0.2), "Call 5550100.": ("fact", 0.0), "My order is 12345.": ("fact", 0.2)}
    last = done.first()
    assert last["action"] == "trimmed" and last["reply"] == f"Hello you. It is red. {fixed.STRICT_NOTE}"
