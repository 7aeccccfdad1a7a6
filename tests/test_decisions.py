import json

from pyspark.sql import functions as F

from plumbline.functions import fixed, maths
from plumbline.operators import requests, scoring

NOUL = {"type": "noul", "instructions": "Is it?"}


def body(questions, state="s"):
    return json.dumps({"state": state, "questions": questions})


def explode(spark, *bodies):
    df = spark.createDataFrame([(str(i), b) for i, b in enumerate(bodies)], "request_id string, body string")
    return requests.explode_tasks(df)


REJECTED = [
    ("[1, 2]", "body", fixed.ERR_BODY), ("not json", "body", fixed.ERR_BODY),
    (json.dumps({"questions": {"q": NOUL}}), "state", fixed.ERR_STATE),
    (json.dumps({"state": "s"}), "questions", fixed.ERR_QUESTIONS), (body({}), "questions", fixed.ERR_QUESTIONS), (body([NOUL]), "questions", fixed.ERR_QUESTIONS),
    (body({"q": "why"}), "questions.q", fixed.ERR_QUESTION),
    (body({"q": {"type": "noul"}}), "questions.q.instructions", fixed.ERR_INSTRUCTIONS), (body({"q": {"type": "noul", "instructions": "  "}}), "questions.q.instructions", fixed.ERR_INSTRUCTIONS),
    (body({"q": {"type": "noul", "instructions": 5}}), "questions.q.instructions", fixed.ERR_INSTRUCTIONS), (body({"q": {"type": "noul", "instructions": {}}}), "questions.q.instructions", fixed.ERR_INSTRUCTIONS),
    (body({"q": {"type": "rank", "instructions": "x"}}), "questions.q.type", fixed.ERR_TYPE), (body({"q": {"instructions": "x"}}), "questions.q.type", fixed.ERR_TYPE),
    (body({"q": {**NOUL, "criteria": {"true": "y"}}}), "questions.q.criteria", fixed.ERR_NOUL), (body({"q": {**NOUL, "criteria": ["a"]}}), "questions.q.criteria", fixed.ERR_NOUL),
    (body({"q": {"type": "choice", "instructions": "x", "criteria": {"a": "1"}}}), "questions.q.criteria", fixed.ERR_CHOICE), (body({"q": {"type": "choice", "instructions": "x"}}), "questions.q.criteria", fixed.ERR_CHOICE),
    (body({"q": {"type": "score", "instructions": "x", "criteria": ["a"]}}), "questions.q.criteria", fixed.ERR_SCORE),
    (body({"q": {"type": "score", "instructions": "x", "criteria": [str(i) for i in range(11)]}}), "questions.q.criteria", fixed.ERR_SCORE),
    (body({"q": {"type": "choice", "instructions": "x", "criteria": {"a": "1", "b": 7}}}), "questions.q.criteria.b", fixed.ERR_CRITERION),
    (body({"q": {"type": "choice", "instructions": "x", "criteria": {"a": "1", "b": {}}}}), "questions.q.criteria.b", fixed.ERR_CRITERION),
    (body({"q": {"type": "score", "instructions": "x", "criteria": ["low", {"what": "high", "examples": "e"}]}}), "questions.q.criteria.1", fixed.ERR_EXAMPLES),
    (body({"q": {"type": "choice", "instructions": "x", "criteria": {f"k{i}": "d" for i in range(256)}}}), "questions.q.criteria", fixed.ERR_MANY),
    (body({"ok": NOUL, "q": {"type": "noul"}}), "questions.q.instructions", fixed.ERR_INSTRUCTIONS),
]


def test_every_rejection_rule(spark):
    rows = explode(spark, *[bad for bad, _, _ in REJECTED], body({"q": NOUL}))
    got = {r["request_id"]: (r["field"], r["message"]) for r in requests.rejected(rows).collect()}
    assert got == {str(i): (field, message) for i, (_, field, message) in enumerate(REJECTED)}
    assert [r["request_id"] for r in requests.accepted(rows).collect()] == [str(len(REJECTED))]


def test_tasks_keep_order_shapes_and_examples(spark):
    questions = {"z": {"type": "choice", "instructions": {"system": "Sys", "instruction": "Ask"}, "criteria": {
        "zeta": {"what": "last", "examples": ["e1", {"k": 1, "a": 2}]}, "alpha": {"note": "n", "b": 1}, "mid": "m"}, "explain": True},
        "a": {"type": "score", "instructions": [1, 2], "criteria": ["low", {"what": "high", "examples": None}]}, "n": {**NOUL, "criteria": {"false": "f", "true": "t"}}, "d": NOUL}
    rows = {r["qid"]: r for r in requests.accepted(explode(spark, body(questions, {"b": 1, "a": [2]}))).orderBy("ord").collect()}
    assert list(rows) == ["z", "a", "n", "d"]
    z = rows["z"]
    assert z["question"] == "Sys\n\nAsk" and z["explain"] and [o["key"] for o in z["options"]] == ["zeta", "alpha", "mid"]
    assert z["options"][1]["description"] == '{"note":"n","b":1}' and z["options"][0]["description"] == "last"
    assert [(e["state_json"], e["gold"]) for e in z["examples"]] == [('"e1"', "zeta"), ('{"k":1,"a":2}', "zeta")]
    assert z["state"] == '{"b":1,"a":[2]}' and not z["state_is_text"]
    assert rows["a"]["question"] == "[1,2]" and [(o["key"], o["description"]) for o in rows["a"]["options"]] == [("0", "low"), ("1", "high")]
    assert [(o["key"], o["description"]) for o in rows["n"]["options"]] == [("true", "t"), ("false", "f")]
    assert rows["d"]["options"][0]["description"] == fixed.YES_DEFAULT


def test_prompt_has_state_last_and_date_facts(spark):
    q = {"type": "choice", "instructions": "Late?", "criteria": {"yes": {"what": "late", "examples": ["Due 2026-01-01, paid 2026-01-03"]}, "no": "on time"}}
    row = requests.with_prompts(requests.accepted(explode(spark, body({"q": q}, "Due 2026-02-01, paid 2026-02-02")))).first()
    text = row["messages"][1]["content"]
    doc = json.loads(text)
    assert list(doc) == ["question", "options", "examples", "state", "facts"]
    assert doc["examples"] == [{"state": "Due 2026-01-01, paid 2026-01-03", "facts": ["2026-01-03 is 2 days after 2026-01-01"], "answer": "A"}]
    assert doc["facts"] == ["2026-02-02 is 1 day after 2026-02-01"] and row["messages"][0]["content"] == fixed.SYSTEM_PROMPT


def test_decide_end_to_end(spark):
    b = body({"team": {"type": "choice", "instructions": "Which team?", "criteria": {"billing": "Payments and refunds", "shipping": "Lost parcels"}}, "sure": NOUL,
              "level": {"type": "score", "instructions": "How bad?", "criteria": ["nothing", "lost parcels everywhere"]}}, "My parcels are lost")
    done, bad = scoring.decide(spark.createDataFrame([("r", b)], "request_id string, body string"))
    got = {r["qid"]: r for r in done.collect()}
    assert bad.count() == 0 and got["team"]["choice"] == "shipping" and abs(sum(got["team"]["probabilities"].values()) - 1) < 1e-3
    assert 0 <= got["team"]["confidence"] <= 1 and 0 <= got["sure"]["noul"] <= 1 and got["sure"]["confidence"] is None
    assert got["level"]["score"] > 0.5 and got["level"]["legend"] == {"0": "nothing", "1": "lost parcels everywhere"}


def wide(spark, *sizes):
    rows = [(str(n), [dict(key=f"k{i}", description=str((i * 37) % 101)) for i in range(n)]) for n in sizes]
    return spark.createDataFrame(rows, "id string, options array<struct<key:string,description:string>>")


def softmax(group):
    return maths.softmax(F.transform(group, lambda o: o["description"].cast("double") / 20))


def reference_tournament(weights, group=8):
    import math
    def decide(w):
        z = [math.exp(x / 20) for x in w]
        return [x / sum(z) for x in z]
    if len(weights) <= group:
        return decide(weights)
    parts = [decide(weights[i:i + group]) for i in range(0, len(weights), group)]
    tops = [p.index(max(p)) for p in parts]
    final = reference_tournament([weights[i * group + t] for i, t in enumerate(tops)], group)
    out = [final[g] * v / p[t] for g, (p, t) in enumerate(zip(parts, tops)) for v in p]
    return [x / sum(out) for x in out]


def test_tournament_in_the_row(spark):
    for r in scoring.tournament(wide(spark, 1, 2, 8, 9, 65, 255), "options", softmax).collect():
        want = reference_tournament([float(o["description"]) for o in r["options"]])
        assert len(r["probs"]) == len(want) and all(abs(a - b) < 1e-9 for a, b in zip(r["probs"], want)), r["id"]


def test_tournament_around_an_outside_scorer(spark):
    def make_client():
        import math

        def client(rows):
            out = []
            for row in rows:
                z = [math.exp(float(o["description"]) / 20) for o in row["options"]]
                out.append({"probs": [x / sum(z) for x in z]})
            return out
        return client

    for r in scoring.tournament_with(wide(spark, 2, 9, 65, 255), "id", make_client, ["options"]).collect():
        want = reference_tournament([float(o["description"]) for o in r["options"]])
        assert all(abs(a - b) < 1e-9 for a, b in zip(r["probs"], want)) and len(want) == len(r["probs"]), r["id"]


def test_failed_calls_become_rows(spark):
    def make_flaky():
        def client(rows):
            if any(row["prompt"] == "bad" for row in rows):
                raise ValueError("no answer")
            return [{"response": row["prompt"].upper(), "finish_reason": "stop"} for row in rows]
        return client

    df = spark.createDataFrame([("a",), ("bad",), ("c",)], "prompt string").coalesce(1)
    got = {r["prompt"]: (r["response"], r["error"]) for r in scoring.generate_with(df, make_flaky, ["prompt"], attempts=2, pause=0.0).collect()}
    assert got["a"] == ("A", None) and got["c"] == ("C", None) and got["bad"][0] is None and "no answer" in got["bad"][1]


def test_sql_functions(spark):
    scoring.register_functions(spark)
    r = spark.sql("""SELECT confidence(array(0.5D, 0.5D)) AS c, decide('my parcels are lost', array(named_struct('key', 'billing', 'description', 'Payments'),
        named_struct('key', 'shipping', 'description', 'Lost parcels'))) AS d, yes_no('all is well', 'all well', 'bad') AS y, rate('bad bad', array('good', 'bad')) AS l,
        retrieval_words('the refunds') AS w, size(date_mentions('2026-01-01 and May 2')) AS m""").first()
    assert r["c"] == 0.0 and r["d"] == "shipping" and r["y"] > 0.5 and r["l"] > 0.5 and r["w"] == ["refund"] and r["m"] == 2
