"""Decision requests: JSON bodies to validated tasks, and probabilities to typed answers.

A request has a `state` (any JSON value) and a `questions` object. Shapes are read through VARIANT, while the order of
questions and options is read from a string map, because VARIANT sorts object keys and option order carries meaning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import dates, fixed, maths, prompts, text
from plumbline.functions.binding import let

TEXT_MAP = "map<string,string>"
EXAMPLES = "array<struct<state_json:string,state:string,gold:string>>"


def _kind(v: Column) -> Column:
    """object, array, string, or other; null when the value is absent or JSON null."""
    return let(F.schema_of_variant(v), lambda s: F.when(s.isNull() | (s == "VOID"), F.lit(None).cast("string"))
               .when(s.startswith("OBJECT"), F.lit("object")).when(s.startswith("ARRAY"), F.lit("array"))
               .when(s == "STRING", F.lit("string")).otherwise(F.lit("other")))


def _part(v: Column, name: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, "$." + name if name else "$", kind)


def _is(kind: Column, *names: str) -> Column:
    return F.coalesce(kind.isin(*names), F.lit(False))


def _plain(raw: Column, is_object: Column) -> Column:
    """Text of an instruction or description: a string as it is, {system, instruction} as two paragraphs, any other
    JSON as compact JSON. `raw` is the text a string map gives for the value."""
    two = F.array(F.lit("instruction"), F.lit("system"))
    return F.when(is_object, let(F.from_json(raw, TEXT_MAP), lambda m: F.when(
        F.array_sort(F.map_keys(m)) == two, F.concat(m["system"], F.lit("\n\n"), m["instruction"])).otherwise(raw))).otherwise(raw)


def _problem(field: Column, message: str | Column) -> Column:
    return F.struct(field.alias("field"), (F.lit(message) if isinstance(message, str) else message).alias("message"))


def _entry(key: Column, value: Column, v: Column) -> Column:
    return F.struct(key.alias("key"), value.alias("value"), v.alias("v"))


def _criterion(e: Column) -> Column:
    """(key, description, examples, bad) of one criterion: a text, other JSON, or {what, examples}."""
    shape = F.struct(_kind(e["v"]).alias("kind"), _kind(_part(e["v"], "what")).alias("what"),
                     _kind(_part(e["v"], "examples")).alias("shown"), F.from_json(e["value"], TEXT_MAP).alias("parts"))

    def read(s: Column) -> Column:
        described = _is(s["kind"], "object") & _is(s["what"], "string")
        listed = described & _is(s["shown"], "array")
        raw = s["parts"]["examples"]
        # absent, null, false, zero and empty values of `examples` all mean "none"
        blank = s["shown"].isNull() | F.coalesce(F.when(s["shown"] == "string", raw == "").otherwise(
            raw.isin("false", "0", "0.0", "{}", "[]")), F.lit(True))
        bad = (F.when(described & ~blank & ~listed, F.lit(fixed.ERR_EXAMPLES))
               .when(~described & (~_is(s["kind"], "string", "object", "array") |
                                   (_is(s["kind"], "object", "array") & e["value"].isin("{}", "[]"))), F.lit(fixed.ERR_CRITERION)))
        shown = F.when(listed, F.transform(F.arrays_zip(
            F.from_json(raw, "array<string>").alias("raw"), _part(e["v"], "examples", "array<variant>").alias("v")),
            lambda x: F.struct(prompts.json_value(x["raw"], _is(_kind(x["v"]), "string")).alias("state_json"),
                               x["raw"].alias("state"), e["key"].alias("gold"))))
        said = F.when(described, s["parts"]["what"]).otherwise(_plain(e["value"], _is(s["kind"], "object")))
        return F.struct(e["key"].alias("key"), said.alias("description"), shown.alias("examples"), bad.alias("bad"))

    return let(shape, read)


def _criteria(kind: Column, raw: Column, v: Column, shape: Column) -> Column:
    """Criteria as (key, value, v) in the order they were given; null when they do not fit the question type."""
    defaults = F.array(*[_entry(F.lit(k), F.lit(d), F.parse_json(prompts.json_string(F.lit(d)))) for k, d in (
        ("true", fixed.YES_DEFAULT), ("false", fixed.NO_DEFAULT))])
    named = let(F.from_json(raw, TEXT_MAP), lambda m: let(_part(v, "", "map<string,variant>"), lambda vs: F.transform(
        F.when(kind == "noul", F.array(F.lit("true"), F.lit("false"))).otherwise(F.map_keys(m)),
        lambda k: _entry(k, m[k], vs[k]))))
    placed = F.transform(F.arrays_zip(F.from_json(raw, "array<string>").alias("raw"), _part(v, "", "array<variant>").alias("v")),
                         lambda x, i: _entry(i.cast("string"), x["raw"], x["v"]))
    return (F.when((kind == "noul") & shape.isNull(), defaults)
            .when(kind.isin("noul", "choice") & (shape == "object"), named)
            .when((kind == "score") & (shape == "array"), placed))


def _question(e: Column) -> Column:
    """One question (qid, raw, v) as (qid, kind, question, options, examples, explain, problem)."""
    shapes = F.struct(_kind(e["v"]).alias("kind"), _kind(_part(e["v"], "type")).alias("type"),
                      _kind(_part(e["v"], "instructions")).alias("asks"), _kind(_part(e["v"], "criteria")).alias("criteria"),
                      F.from_json(e["raw"], TEXT_MAP).alias("f"))

    def read(s: Column, kind: Column) -> Column:
        return F.struct(
            s["kind"].alias("shape"), kind.alias("kind"), s["asks"].alias("asks"), s["criteria"].alias("criteria_shape"),
            s["f"]["instructions"].alias("raw_question"),
            text.strip(_plain(s["f"]["instructions"], _is(s["asks"], "object"))).alias("question"), s["f"]["explain"].alias("explain"),
            F.map_keys(F.when(s["criteria"] == "object", F.from_json(s["f"]["criteria"], TEXT_MAP))).alias("named"),
            F.transform(_criteria(kind, s["f"]["criteria"], _part(e["v"], "criteria"), s["criteria"]), _criterion).alias("read"))

    def checked(q: Column) -> Column:
        where = F.concat(F.lit("questions."), e["qid"])
        crit = F.concat(where, F.lit(".criteria"))
        first_bad = F.get(F.filter(q["read"], lambda r: r["bad"].isNotNull()), 0)
        count = F.coalesce(F.size(q["read"]), F.lit(-1))
        unasked = (~_is(q["asks"], "string", "object", "array") | F.coalesce(q["question"] == "", F.lit(True))
                   | F.coalesce(q["raw_question"].isin("{}", "[]") & (q["asks"] != "string"), F.lit(False)))
        both = F.coalesce(F.array_sort(q["named"]) == F.array(F.lit("false"), F.lit("true")), F.lit(False))
        found = (F.when(~_is(q["shape"], "object"), _problem(where, fixed.ERR_QUESTION))
                 .when(unasked, _problem(F.concat(where, F.lit(".instructions")), fixed.ERR_INSTRUCTIONS))
                 .when(~_is(q["kind"], "noul", "choice", "score"), _problem(F.concat(where, F.lit(".type")), fixed.ERR_TYPE))
                 .when((q["kind"] == "noul") & q["criteria_shape"].isNotNull() & ~both, _problem(crit, fixed.ERR_NOUL))
                 .when((q["kind"] == "choice") & (~_is(q["criteria_shape"], "object") | (count < 2)), _problem(crit, fixed.ERR_CHOICE))
                 .when((q["kind"] == "score") & (~_is(q["criteria_shape"], "array") | (count < 2) | (count > 10)),
                       _problem(crit, fixed.ERR_SCORE))
                 .when(first_bad.isNotNull(), _problem(F.concat(crit, F.lit("."), first_bad["key"]), first_bad["bad"]))
                 .when(count > fixed.MAX_OPTIONS, _problem(crit, fixed.ERR_MANY)))
        truthy = F.coalesce(~q["explain"].isin("false", "0", "", "[]", "{}", "null"), F.lit(False))
        shots = F.flatten(F.filter(F.transform(q["read"], lambda r: r["examples"]), lambda x: x.isNotNull()))
        return F.struct(e["qid"].alias("qid"), q["kind"].alias("kind"), q["question"].alias("question"),
                        F.transform(q["read"], lambda r: F.struct(r["key"].alias("key"), r["description"].alias("description"))).alias("options"),
                        F.coalesce(shots, F.array().cast(EXAMPLES)).alias("examples"), truthy.alias("explain"), found.alias("problem"))

    return let(shapes, lambda s: let(let(F.when(s["type"] == "string", s["f"]["type"]), lambda kind: read(s, kind)), checked))


def parse_requests(requests: DataFrame, request_id: str = "request_id", body: str = "body") -> DataFrame:
    """One row per request: (request_id, state, state_is_text, problem, tasks). `problem` (field, message) is the first of the whole
    request, in the order of its questions, and null for a good one; `tasks` are its questions in order. Everything is decided
    inside the row, from one reading of the JSON: nothing is joined, grouped or shuffled, in a batch or in a stream."""
    def request(v: Column) -> Column:
        def read(kind: Column, top: Column, asked: Column) -> Column:
            whole = (F.when(~_is(kind, "object"), _problem(F.lit("body"), fixed.ERR_BODY))
                     .when(~F.coalesce(F.map_contains_key(top, F.lit("state")), F.lit(False)), _problem(F.lit("state"), fixed.ERR_STATE))
                     .when(F.coalesce(F.size(asked), F.lit(0)) <= 0, _problem(F.lit("questions"), fixed.ERR_QUESTIONS)))
            entries = F.transform(F.map_entries(F.from_json(top["questions"], TEXT_MAP)), lambda e: F.struct(
                e["key"].alias("qid"), e["value"].alias("raw"), asked[e["key"]].alias("v")))
            return let(whole, lambda w: let(F.when(w.isNull(), F.transform(entries, _question)), lambda tasks: F.struct(
                F.coalesce(top["state"], F.lit("null")).alias("state"), _is(_kind(_part(v, "state")), "string").alias("state_is_text"),
                F.coalesce(w, F.get(F.filter(F.transform(tasks, lambda t: t["problem"]), lambda p: p.isNotNull()), 0)).alias("problem"),
                F.transform(tasks, lambda t: F.struct(*[t[c].alias(c) for c in TASK])).alias("tasks"))))

        return let(_kind(v), lambda kind: let(F.when(kind == "object", F.from_json(F.col(body), TEXT_MAP)), lambda top: let(
            _part(v, "questions", "map<string,variant>"), lambda asked: read(kind, top, asked))))

    # a generator's output is not put into what reads it, so the JSON is read once however often its parts are named
    return requests.select(request_id, F.explode_outer(F.array(let(F.try_parse_json(F.col(body)), request))).alias("_p")).select(request_id, "_p.*")


TASK = ["qid", "kind", "question", "options", "examples", "explain"]


def explode_tasks(requests: DataFrame, request_id: str = "request_id", body: str = "body") -> DataFrame:
    """One row per question of each good request: (request_id, ord, qid, kind, question, options, examples, explain, state, state_is_text,
    seen, field, message); `seen` are the state's distinct retrieval words. A rejected request is one row that has only field and message."""
    parsed = parse_requests(requests, request_id, body)
    good = F.col("problem").isNull()
    ready = parsed.select(request_id, "problem", "state", "state_is_text", F.explode_outer(F.array(F.struct(
        F.when(good, F.array_distinct(text.retrieval_words(F.col("state")))).alias("seen"), F.when(good, F.col("tasks")).alias("tasks")))).alias("_r"))
    rows = ready.select(request_id, "problem", "state", "state_is_text", F.col("_r.seen").alias("seen"), F.posexplode_outer("_r.tasks").alias("ord", "_t"))
    return rows.select(request_id, "ord", *[f"_t.{c}" for c in TASK], "state", "state_is_text", "seen", "problem.field", "problem.message")


def rejected(exploded: DataFrame, request_id: str = "request_id") -> DataFrame:
    """The first problem of each rejected request."""
    return exploded.filter(F.col("field").isNotNull()).select(request_id, "field", "message")


def accepted(exploded: DataFrame, request_id: str = "request_id") -> DataFrame:
    """Tasks of the requests without any problem."""
    return exploded.filter(F.col("field").isNull()).drop("field", "message")


def with_prompts(tasks: DataFrame) -> DataFrame:
    """Adds the compact prompt `messages`; the state and every worked example carry their date facts."""
    found = (tasks.withColumn("_facts", dates.date_facts(F.col("state")))
             .withColumn("_shot_facts", dates.facts_each(F.transform("examples", lambda e: e["state"]))))
    shots = F.transform("examples", lambda e, i: F.struct(
        e["state_json"].alias("state_json"), F.get(F.col("_shot_facts"), i).alias("facts"), e["gold"].alias("gold")))
    body = prompts.decision_body(F.col("question"), F.col("options"),
                                 prompts.json_value(F.col("state"), F.col("state_is_text")), F.col("_facts"), shots)
    return (found.withColumn("messages", prompts.decision_messages(body, F.col("explain")))
            .drop("_facts", "_shot_facts"))


def answers(scored: DataFrame) -> DataFrame:
    """Typed answers from `kind`, `options` and the array `probs` in option order."""
    keys = F.transform("options", lambda o: o["key"])
    shown = F.map_from_arrays(keys, F.transform("probs", lambda p: F.round(p, 4)))
    level = F.when(F.col("kind") != "noul", maths.confidence(F.col("probs")))
    return (scored
            .withColumn("noul", F.when(F.col("kind") == "noul", F.round(F.element_at(
                "probs", F.array_position(keys, "true").cast("int")), 4)))
            .withColumn("choice", F.when(F.col("kind") == "choice", F.element_at(keys, maths.first_top(F.col("probs")))))
            .withColumn("score", F.when(F.col("kind") == "score", F.round(maths.expected_level(F.col("probs")), 4)))
            .withColumn("probabilities", F.when(F.col("kind") != "noul", shown))
            .withColumn("legend", F.when(F.col("kind") == "score", F.map_from_arrays(
                keys, F.transform("options", lambda o: o["description"]))))
            .withColumn("confidence", level))
