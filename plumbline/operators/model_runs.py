"""Runs around an outside model that can stop at any time and go on: labelling, distillation, teacher chats and judged comparisons.

`call` is always a function that takes rows and returns them with the model's columns, such as
``lambda rows: scoring.generate_with(rows, factory, ["messages"], keep=False)`` (adds response, finish_reason, error); a native
function of columns serves as well. What a call gave is written before anything else is done with it, and never asked for twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import draws, fixed, maths, prompts, text
from plumbline.operators import curation, metrics

Call = Callable[[DataFrame], DataFrame]
TEMPLATES_A_TASK = 5_000  # their prompts and labels are sorted in one task, which small compressed input would fill with far more
FEW_SHOT_OPTIONS = 8  # with more options a worked example per option would repeat all of them too often


# ---- the journal ------------------------------------------------------------------------------------------------------

def written(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """The rows at `path`, none if nothing was written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def resumed(rows: DataFrame, key: str, call: Call, path: str, batches: int = 1, finished: Column | None = None) -> DataFrame:
    """The results of `call` for `rows`, from the journal at `path`: rows whose `key` is in it are not called again, the others are,
    in `batches` parts, and each part is appended when it is done. Results for which `finished` does not hold (a failed call) are not
    kept, so a later run tries them again; whatever else of a run was written before it ended is there for the next one."""
    spark, named = rows.sparkSession, f"_part_{key}"
    sample = call(rows.limit(0))
    for n in range(batches):
        part = rows.where(F.pmod(F.xxhash64(F.col(key)), F.lit(batches)) == n) if batches > 1 else rows
        done = written(spark, path, sample.schema).select(F.col(key).alias(named)).distinct()
        todo = part.join(done, part[key].eqNullSafe(done[named]), "left_anti")
        if todo.head() is not None:
            got = call(todo)
            (got if finished is None else got.where(finished)).write.mode("append").parquet(path)
    asked = rows.select(F.col(key).alias(named)).distinct()
    return written(spark, path, sample.schema).join(asked, F.col(key).eqNullSafe(F.col(named)), "left_semi")


# ---- labelling --------------------------------------------------------------------------------------------------------

def label_rows(templates: DataFrame) -> DataFrame:
    """One row per half of a pair: (tid, at, side, state, options, messages). Templates with up to FEW_SHOT_OPTIONS options show their
    worked examples, one per option; with more the question is asked without."""
    few = F.size("options") <= FEW_SHOT_OPTIONS
    shots = F.transform(F.when(few, F.col("examples")).otherwise(F.slice("examples", 1, 0)), lambda e: F.struct(
        prompts.json_string(e["state"]).alias("state_json"), e["gold"].alias("gold")))
    halves = F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"p.{s}").alias("state")) for s in ("a", "b")])
    rows = templates.withColumn("_shots", shots).select("tid", "question", "options", "_shots", F.posexplode("pairs").alias("at", "p"))
    rows = rows.select("tid", "question", "options", "_shots", "at", F.explode(halves).alias("h")).select("tid", "question", "options", "_shots", "at", "h.*")
    return rows.select("tid", "at", "side", "state", "options", prompts.turn_messages(
        prompts.json_string(F.col("state")), F.col("question"), F.col("options"), F.col("_shots")).alias("messages"))


def label(templates: DataFrame, call: Call, path: str, batches: int = 1) -> DataFrame:
    """`templates` (tid, question, options, examples, pairs) with teacher_a and teacher_b (option key to probability) in every pair.
    `call` adds `seen`, the probability of each token at the answer's place, and `error` to the rows of `label_rows`. A template with any
    failed half is left out, so that the next run labels it whole; finished templates come from the journal at `path`."""
    parts = max(templates.sparkSession.sparkContext.defaultParallelism, -(-templates.count() // TEMPLATES_A_TASK))
    keys = F.transform("options", lambda o: o["key"])
    letters = F.transform("options", lambda o, i: prompts.label_at(i))

    def one(todo: DataFrame) -> DataFrame:
        scored = call(label_rows(todo.repartition(parts, "tid"))).withColumn("probs", F.map_from_arrays(keys, maths.letter_probs(F.col("seen"), letters)))
        half = lambda s: F.max_by("probs", F.when(F.col("side") == s, 1)).alias(f"teacher_{s}")
        pairs = scored.groupBy("tid", "at").agg(half("a"), half("b"), F.count("seen").alias("n"), F.max("error").alias("error"))
        return pairs.groupBy("tid").agg(F.map_from_entries(F.collect_list(F.struct("at", F.struct("teacher_a", "teacher_b")))).alias("labels"),
                                        F.max("error").alias("error"), F.sum("n").alias("n"))

    whole = F.col("error").isNull() & (F.col("n") == 2 * F.size("labels"))
    labels = resumed(templates, "tid", one, path, batches, whole).select(F.col("tid").alias("_tid"), "labels")
    merged = F.transform("pairs", lambda p, i: p.withField("teacher_a", F.col("labels")[i]["teacher_a"]).withField("teacher_b", F.col("labels")[i]["teacher_b"]))
    # labels are maps, which take some forty times their compressed size in memory: never broadcast
    return templates.repartition(parts, "tid").join(labels.hint("merge"), F.col("tid") == F.col("_tid")).withColumn("pairs", merged).drop("_tid", "labels")


# ---- distillation -----------------------------------------------------------------------------------------------------

def distil(rows: DataFrame, key: str, call: Call, path: str, batches: int = 1) -> DataFrame:
    """(key, messages, response, truncated): the model's answers to `rows` (key, messages). Empty and failed answers are not kept and are
    asked for again by the next run."""
    def one(todo: DataFrame) -> DataFrame:
        said = call(todo.select(key, "messages"))
        return said.select(key, "messages", text.strip(F.col("response")).alias("response"), (~curation.complete(F.col("finish_reason"))).alias("truncated"), "error")

    kept = F.col("error").isNull() & (F.coalesce(F.col("response"), F.lit("")) != "")
    return resumed(rows, key, one, path, batches, kept).drop("error")


def summaries(threads: DataFrame, key: str, call: Call, path: str, batches: int = 1) -> DataFrame:
    """`distil` over summary prompts of `threads` (key, text, focus, lang). For languages other than English the model is told which one to
    write in; that turn is not kept, so a stored row holds the prompt that the student will see."""
    plain = threads.withColumn("messages", prompts.summary_messages(F.col("text"), F.col("focus")))
    nudge = F.when(~F.col("lang").isin("English", "en"), F.array(prompts.message("system", F.concat(F.lit("Write the summary in "), "lang", F.lit("."))))).otherwise(F.slice("messages", 1, 0))
    said = distil(plain.select(key, F.concat(nudge, "messages").alias("messages")), key, call, path, batches)
    return plain.select(key, "lang", "messages").join(said.drop("messages"), key)


# ---- teacher chats ----------------------------------------------------------------------------------------------------

CARRY = 0.3  # share of questions that keep the turn before


def teacher_chat(jobs: DataFrame, call: Call, path: str, says_unknown: Call | None = None, seed: int = 0) -> DataFrame:
    """Grounded chats, one question after another: (id, turn, lang, messages, response, truncated, answerable) of the replies that stay.

    `jobs` are (id, lang, system, passages, questions: array of (question, answerable)). In each round the next question of every job is
    asked over its passages, sometimes (CARRY, by a draw) behind the last turn that stayed; empty replies go, and so do replies to
    unanswerable questions that do not decline: by pattern in English, else by the verdict of `says_unknown` (adds `verdict` to rows
    with `response`). A round is one table below `path`, made from the one before; a run that stopped goes on behind its last whole round."""
    spark = jobs.sparkSession
    before, rounds = None, jobs.agg(F.max(F.size("questions"))).first()[0] or 0
    turn = "struct<role:string,content:string>"
    schema = T.StructType([jobs.schema["id"], *spark.createDataFrame([], f"turn int, lang string, messages array<{turn}>, response string, truncated boolean, answerable boolean, kept boolean, last array<{turn}>").schema.fields])
    for j in range(rounds):
        place = f"{path}/turn={j}"
        if written(spark, f"{place}/done", "n long").head() is None:
            asked = jobs.where(F.size("questions") > j).select("id", "lang", "system", "passages", F.get("questions", j).alias("q"))
            if before is None:
                asked = asked.withColumn("last", F.array().cast(f"array<{turn}>"))
            else:
                asked = asked.join(before.select(F.col("id").alias("_id"), "last"), F.col("id") == F.col("_id"), "left").drop("_id")
            carried = F.when(draws.unit(seed, F.col("id"), F.lit(j), salt="carry") < CARRY, F.col("last")).otherwise(F.slice("last", 1, 0))
            own = F.when(F.col("system").isNotNull(), F.array(prompts.message("system", F.col("system")))).otherwise(F.slice("last", 1, 0))
            question = F.array(prompts.message("user", F.col("q.question")))
            rows = asked.withColumn("messages", prompts.knowledge_messages(F.concat(own, carried, question), F.col("passages")))
            said = call(rows).withColumn("response", text.strip(F.col("response")))
            foreign = ~F.col("lang").isin("English", "en")
            if says_unknown is not None:
                said = says_unknown(said)
            declines = curation.refuses(F.col("response")) if says_unknown is None else F.when(foreign, yes(F.col("verdict"))).otherwise(curation.refuses(F.col("response")))
            kept = F.coalesce(F.col("error").isNull() & (F.col("response") != "") & (F.col("q.answerable") | declines), F.lit(False))
            now = F.array(prompts.message("user", F.col("q.question")), prompts.message("assistant", F.col("response")))
            state = said.withColumn("kept", kept).select(
                "id", F.lit(j).alias("turn"), "lang", "messages", "response", (~curation.complete(F.col("finish_reason"))).alias("truncated"),
                F.col("q.answerable").alias("answerable"), "kept", F.when(F.col("kept"), now).otherwise(F.coalesce("last", F.slice(now, 1, 0))).alias("last"))
            state.write.mode("overwrite").parquet(f"{place}/rows")
            spark.range(1).select(F.col("id").alias("n")).write.mode("overwrite").parquet(f"{place}/done")
        before = written(spark, f"{place}/rows", schema)
    whole = [written(spark, f"{path}/turn={j}/rows", schema) for j in range(rounds)]
    out = whole[0] if whole else spark.createDataFrame([], schema)
    for more in whole[1:]:
        out = out.unionByName(more)
    return out.where("kept").drop("kept", "last")


# ---- grounded questions -----------------------------------------------------------------------------------------------

DISTRACTORS = 3


def grounded_questions(rows: DataFrame, contexts: DataFrame, call: Call, path: str, says_unknown: Call | None = None, batches: int = 1, seed: int = 0) -> DataFrame:
    """Replies to questions over their own passage among others: (id, lang, messages, response, answerable) of those that hold.

    `rows` are (id, doc, context, question, span, lang): `span` is the verified answer, null or blank where the context has none, `lang` the
    language to ask in, null for English. `contexts` (doc, text) give DISTRACTORS passages of other documents. Questions in another
    language are translated first. The model is told the answer (or that there is none) in a private note behind the question, which is not
    kept. A reply stays if it is whole and states the answer, or declines where there is none; foreign declines are left to
    `says_unknown` (adds `verdict`). Every reply is in the journal at `path`, the dropped ones too, so none is asked for twice."""
    english = F.lit("English")
    foreign = F.col("lang").isNotNull()
    asked = rows.withColumn("question", text.strip(F.col("question")))
    translate = asked.where(foreign).select("id", F.array(prompts.message("user", filled(fixed.QUESTION_TRANSLATE_PROMPT, lang=F.col("lang"), question=F.col("question")))).alias("messages"))
    said = distil(translate, "id", call, f"{path}/translated", batches).where("not truncated").select(F.col("id").alias("_id"), F.col("response").alias("_said"))
    asked = asked.join(said, F.col("id") == F.col("_id"), "left").withColumn("question", F.when(foreign, F.col("_said")).otherwise(F.col("question"))).where("question is not null").drop("_id", "_said")
    others = curation.distractors(asked.select("id", "doc"), contexts, "id", "doc", DISTRACTORS, seed).groupBy(F.col("id").alias("_id")).agg(F.array_sort(F.collect_list(F.struct("rank", "passage"))).alias("_others"))
    shown = F.concat(F.array(text.strip(F.col("context"))), F.coalesce(F.transform("_others", lambda o: o["passage"]), F.array().cast("array<string>")))
    asked = asked.join(others, F.col("id") == F.col("_id"), "left").withColumn("passages", draws.shuffle_array(shown, seed, F.col("id"), lambda p: F.md5(p))).drop("_id", "_others")
    answerable = text.strip(F.coalesce("span", F.lit(""))) != ""
    hint = F.when(answerable, filled(fixed.HINT_ANSWER, span=F.col("span"), lang=F.coalesce("lang", english))).otherwise(filled(fixed.HINT_DECLINE, lang=F.coalesce("lang", english)))
    plain = asked.withColumn("kept_messages", prompts.knowledge_messages(F.array(prompts.message("user", F.col("question"))), F.col("passages")))
    noted = F.concat(F.expr("slice(kept_messages, 1, size(kept_messages) - 1)"), F.array(prompts.message("user", F.concat("question", F.lit("\n\n"), hint))))

    def one(todo: DataFrame) -> DataFrame:
        got = call(todo.withColumn("messages", noted)).withColumn("response", text.strip(F.col("response")))
        got = got if says_unknown is None else says_unknown(got)
        declines = None if says_unknown is None else yes(F.col("verdict"))
        holds = curation.grounded_reply_kept(F.col("response"), F.col("span"), F.col("lang").isNotNull(), declines)
        kept = curation.complete(F.col("finish_reason")) & (F.col("response") != "") & holds
        return got.select("id", F.coalesce("lang", english).alias("lang"), F.col("kept_messages").alias("messages"), "response", answerable.alias("answerable"), F.coalesce(kept, F.lit(False)).alias("kept"), "error")

    return resumed(plain, "id", one, f"{path}/replies", batches, F.col("error").isNull()).where("kept").drop("kept", "error")


# ---- judged comparisons -----------------------------------------------------------------------------------------------

def yes(verdict: Column) -> Column:
    """A yes/no verdict: whatever begins with y is yes; no verdict is null."""
    return F.lower(text.strip(verdict)).startswith("y")


def filled(template: str, **parts: Column) -> Column:
    """The template with its {names} replaced, each once and none inside what another put there."""
    pieces, rest = [], template
    while "{" in rest:
        head, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        pieces += [F.lit(head), F.coalesce(parts[name], F.lit(""))]
    return F.concat(*pieces, F.lit(rest))


def judge_rows(questions: DataFrame, replies: DataFrame) -> DataFrame:
    """Two judge questions for each reply: (id, arm, asked, prompt), `asked` being acceptable or invents. `questions` are (id, lang,
    answerable, messages, reference); `replies` are (id, arm, reply)."""
    said = F.array_join(F.transform("messages", lambda m: F.concat(F.upper(m["role"]), F.lit(": "), m["content"])), "\n\n")
    status = F.when(F.col("answerable"), fixed.JUDGE_ANSWERED).otherwise(fixed.JUDGE_NOT_ANSWERED)
    both = replies.join(questions, "id")
    parts = {"conversation": said, "reply": F.col("reply"), "reference": F.col("reference"), "status": status}
    asked = [("acceptable", fixed.JUDGE_PROMPT), ("invents", fixed.INVENTS_PROMPT)]
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("asked"), filled(p, **parts).alias("prompt")) for n, p in asked]))
    return both.select("id", "arm", rows.alias("j")).select("id", "arm", "j.*")


def knowledge_evaluation(questions: DataFrame, replies: DataFrame, call: Call, path: str, batches: int = 1) -> tuple[DataFrame, DataFrame]:
    """(rates per arm, judged replies). Every reply gets two verdicts from the journal at `path`; only questions that every arm has
    replied to, with both verdicts, count, so that arms are compared on the same questions. Judged replies are (id, arm, lang,
    answerable, acceptable, invents) of those."""
    keyed = judge_rows(questions, replies).withColumn("row", F.concat_ws("\x1f", "id", "arm", "asked"))
    said = resumed(keyed, "row", call, path, batches, F.col("error").isNull() & F.col("response").isNotNull())
    flag = lambda n: F.bool_or(F.when(F.col("asked") == n, yes(F.col("response")))).alias(n)
    each = said.groupBy("id", "arm").agg(flag("acceptable"), flag("invents")).where("acceptable is not null and invents is not null")
    arms = replies.agg(F.count_distinct("arm").alias("n")).scalar()
    same = each.groupBy("id").agg(F.count_distinct("arm").alias("n")).where(F.col("n") == arms).select("id")
    judged = each.join(same, "id").join(questions.select("id", "lang", "answerable"), "id").select("id", "arm", "lang", "answerable", "acceptable", "invents")
    return metrics.knowledge_rates(judged, ["arm"]), judged


def comparison_rows(pairs: DataFrame) -> DataFrame:
    """(id, order, prompt): every pair (id, prompt, a, b) twice, with a first (order 1) and with b first (order 2)."""
    shown = lambda n, x, y: F.struct(F.lit(n).alias("order"), filled(fixed.PAIRWISE_PROMPT, prompt=F.col("prompt"), a=F.col(x), b=F.col(y)).alias("prompt"))
    return pairs.select("id", F.explode(F.array(shown(1, "a", "b"), shown(2, "b", "a"))).alias("c")).select("id", "c.*")


def compare_answers(pairs: DataFrame, call: Call, path: str, batches: int = 1) -> tuple[DataFrame, DataFrame]:
    """(win rate, verdicts). Two blind verdicts a pair from the journal at `path`; pairs with a failed call count in neither order."""
    keyed = comparison_rows(pairs).withColumn("row", F.concat_ws("\x1f", "id", "order"))
    said = resumed(keyed, "row", call, path, batches, F.col("error").isNull() & F.col("response").isNotNull())
    whole = said.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n = 2").select("id")
    verdicts = said.join(whole, "id", "left_semi").select("id", "order", F.col("response").alias("verdict"))
    return metrics.win_rate(verdicts), verdicts
