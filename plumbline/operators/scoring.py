"""Scorers and generators as plug-ins, the built-in deterministic scorer, and the many-option tournament."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import dates, fixed, maths, text
from plumbline.functions.binding import let
from plumbline.operators import requests
from plumbline.session import materialise


def overlap_scorer(state: Column, seen: Column | None = None) -> Callable[[Column], Column]:
    """The built-in scorer: softmax over the number of words each option (key and description) shares with the state, whose distinct
    retrieval words are `seen` where they are known. It stands in for a model, so that every step around the model can run and be
    tested. All native."""
    def score(options: Column) -> Column:
        shared = let(F.array_distinct(text.retrieval_words(state)) if seen is None else seen, lambda seen: F.transform(options, lambda o: F.size(
            F.array_intersect(seen, text.retrieval_words(F.concat_ws(
                " ", F.regexp_replace(o["key"], "_", " "), o["description"])))).cast("double")))
        return maths.softmax(shared)

    return score


def rounds_for(most: int, group: int) -> int:
    """Rounds until one group is left of `most` options."""
    rounds = 1
    while group ** rounds < most:
        rounds += 1
    return rounds


def most_options(df: DataFrame, options: str) -> int:
    """The largest number of options of any row; a stream can't be asked and may have as many as a request may."""
    return fixed.MAX_OPTIONS if df.isStreaming else df.agg(F.max(F.size(options))).first()[0] or 1


def tournament(df: DataFrame, options: str, score: Callable[[Column], Column], out: str = "probs",
               group: int = fixed.GROUP_SIZE, most: int | None = None) -> DataFrame:
    """Probabilities for any number of options. Options are decided in groups of `group`, each group's winner goes to
    the next round, and an eliminated option keeps its share within its group times the final probability of that
    group's winner. Everything happens inside the row and nothing is shuffled. `most` is the largest number of options,
    which is counted if it isn't given; a row with more ends the job instead of losing its probabilities."""
    rounds = rounds_for(most_options(df, options) if most is None else most, group)

    def round_of(opts: Column) -> Column:
        """Groups of `opts` with their probabilities and the place of the winner."""
        groups = F.transform(F.sequence(F.lit(0), F.floor((F.size(opts) - 1) / group).cast("int")),
                             lambda i: F.slice(opts, i * group + 1, group))
        return F.transform(groups, lambda g: let(score(g), lambda p: F.struct(
            p.alias("p"), maths.first_top(p).alias("at"), F.element_at(g, maths.first_top(p)).alias("winner"))))

    def play(opts: Column, left: int) -> Column:
        if left == 0:
            return F.array(F.lit(1.0))
        return let(round_of(opts), lambda r: let(play(F.transform(r, lambda g: g["winner"]), left - 1), lambda final: maths.normalised(
            F.flatten(F.transform(r, lambda g, i: F.transform(g["p"], lambda v: F.get(final, i) * v / F.element_at(g["p"], g["at"])))))))

    few, many = F.size(options) <= group, F.size(options) > group ** rounds
    played = score(F.col(options)) if rounds == 1 else F.when(few, score(F.col(options))).otherwise(play(F.when(~few & ~many, F.col(options)), rounds))
    return df.withColumn(out, F.when(many, F.raise_error(F.lit(f"more than {group ** rounds} options")).cast("array<double>")).otherwise(played))


def _retry(call, rows: list[dict], attempts: int, pause: float):
    for i in range(attempts):
        try:
            return call(rows), None
        except Exception as e:  # a failed call becomes a row, never a failed job
            problem = f"{type(e).__name__}: {e}"[:300]
            if i + 1 < attempts:
                time.sleep(pause * 2 ** i)
    return None, problem


FAILURES = 8  # rows of a batch that may fail one by one before the rest of it is given up


def _each(call, rows: list[dict], attempts: int, pause: float, left: list[int], whole: bool = True) -> list[tuple]:
    """(answer, error) of every row. A failing batch is halved until the rows that fail are found: halves are tried once, single rows
    with all attempts, and after `left` failed rows what is still open gets the last error without further calls, so that
    a service that is down costs a few calls a batch and not one (with its pauses) a row."""
    got, problem = _retry(call, rows, attempts if whole or len(rows) == 1 else 1, pause)
    if got is not None:
        return [(one, None) for one in got]
    if len(rows) == 1:
        left[0] -= 1
        return [(None, problem)]
    out: list[tuple] = []
    for part in (rows[:len(rows) // 2], rows[len(rows) // 2:]):
        out += _each(call, part, attempts, pause, left, False) if left[0] > 0 else [(None, problem)] * len(part)
    return out


def _plug_in(df: DataFrame, factory, columns: list[str], added: list[T.StructField], attempts: int, pause: float,
             label: str, keep: bool) -> DataFrame:
    schema = T.StructType([*df.schema.fields, *added, T.StructField("error", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = factory()
        for batch in batches:
            rows = batch[columns].to_dict("records")
            pairs = _each(client, rows, attempts, pause, [FAILURES]) if rows else []
            out = batch.copy()
            for field in added:
                out[field.name] = [None if one is None else one[field.name] for one, _ in pairs]
            out["error"] = [issue for _, issue in pairs]
            yield out

    scored = df.mapInPandas(run, schema)
    return materialise(scored, label) if keep else scored


def score_with(tasks: DataFrame, factory: Callable[[], Callable[[list[dict]], list[dict]]],
               columns: list[str], attempts: int = 4, pause: float = 1.0, keep: bool = True) -> DataFrame:
    """Run an outside scorer. `factory()` is called once per partition and returns a client that takes a batch of rows
    (dicts of `columns`, for example messages and options) and returns one dict with `probs` each. The Arrow batch size
    (spark.sql.execution.arrow.maxRecordsPerBatch) is the model's batch size. With `keep` the output is written once,
    so that no later action calls the model again."""
    return _plug_in(tasks, factory, columns, [T.StructField("probs", T.ArrayType(T.DoubleType()))], attempts, pause,
                    "scored", keep)


def generate_with(rows: DataFrame, factory, columns: list[str], attempts: int = 4, pause: float = 1.0,
                  keep: bool = True) -> DataFrame:
    """Run an outside text generator: adds `response`, `finish_reason` and `error`."""
    return _plug_in(rows, factory, columns, [T.StructField("response", T.StringType()),
                                             T.StructField("finish_reason", T.StringType())], attempts, pause,
                    "generated", keep)


def tournament_with(tasks: DataFrame, key: str, factory, columns: list[str], group: int = fixed.GROUP_SIZE,
                    most: int | None = None, render: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The tournament around an outside scorer: each round scores one row per group of more than one option and then
    collects a task's groups again; every round is written once. `columns` name what the scorer reads; `options` is
    replaced by the group's options and worked examples (if any) by those of the group, and `render`, if given, then
    adds what else the scorer reads, such as the prompt. Adds `probs` and `error`: a task with a failed call goes no
    further and has the first error instead of probabilities."""
    rounds = rounds_for(most_options(tasks, "options") if most is None else most, group)
    has_examples = "examples" in tasks.columns
    current, out = tasks, tasks.withColumn("error", F.lit(None).cast("string"))
    for r in range(rounds):
        split = current.withColumn("_groups", F.transform(
            F.sequence(F.lit(0), F.floor((F.size("options") - 1) / group).cast("int")),
            lambda i: F.slice("options", i * group + 1, group)))
        rows = split.select(*[c for c in split.columns if c not in ("options", "_groups")],
                            F.posexplode("_groups").alias("_at", "options"))
        if has_examples:
            rows = rows.withColumn("examples", F.filter("examples", lambda e: F.exists(
                "options", lambda o: o["key"] == e["gold"])))
        asked = rows.filter(F.size("options") > 1)
        scored = score_with(render(asked) if render else asked, factory, columns).select(key, "_at", "options", "probs", "error")
        alone = rows.filter(F.size("options") == 1).select(
            key, "_at", "options", F.array(F.lit(1.0)).alias("probs"), F.lit(None).cast("string").alias("error"))
        level = scored.unionByName(alone).groupBy(key).agg(
            F.array_sort(F.collect_list(F.struct("_at", "options", "probs"))).alias(f"_l{r}"),
            F.min_by("error", F.when(F.col("error").isNotNull(), F.col("_at"))).alias("_e"))
        level = materialise(level, "round")
        out = out.join(level, key, "left").withColumn("error", F.coalesce("error", "_e")).drop("_e")
        winners = level.filter(F.col("_e").isNull()).select(key, F.transform(f"_l{r}", lambda s: F.element_at(
            s["options"], maths.first_top(s["probs"]))).alias("options"))
        current = current.drop("options").join(winners, key)
    final = F.array(F.lit(1.0))
    for r in reversed(range(rounds)):
        out = out.withColumn("_final", final if r == rounds - 1 else F.col("_final"))
        out = out.withColumn("_final", maths.normalised(F.flatten(F.transform(f"_l{r}", lambda s, i: F.transform(
            s["probs"], lambda v: F.get(F.col("_final"), i) * v / F.array_max(s["probs"]))))))
    return out.withColumn("probs", F.when(F.col("error").isNull(), F.col("_final"))).select(*tasks.columns, "probs", "error")


def decide(bodies: DataFrame, request_id: str = "request_id", body: str = "body", factory=None,
           prompts: bool = True) -> tuple[DataFrame, DataFrame]:
    """Requests to (answers, rejects). Without `factory` the built-in scorer is used and nothing leaves the JVM;
    with it, the outside scorer sees `messages` and `options` of one group at a time, and a request whose call failed is among the rejects with the error."""
    exploded = requests.explode_tasks(bodies, request_id, body)
    tasks = requests.accepted(exploded, request_id)
    refused = requests.rejected(exploded, request_id)
    if factory is None:
        asked = requests.with_prompts(tasks) if prompts else tasks
        return requests.answers(tournament(asked, "options", overlap_scorer(F.col("state"), F.col("seen")), most=fixed.MAX_OPTIONS)), refused
    keyed = tasks.drop("seen").withColumn("_task", F.concat_ws("/", request_id, "qid"))
    scored = tournament_with(keyed, "_task", factory, ["messages", "options"], most=fixed.MAX_OPTIONS, render=requests.with_prompts).drop("_task")
    failed = scored.filter(F.col("error").isNotNull()).groupBy(request_id).agg(F.min_by(F.struct("qid", "error"), "ord").alias("e")).select(
        request_id, F.concat(F.lit("questions."), F.col("e.qid")).alias("field"), F.col("e.error").alias("message"))
    return requests.answers(scored.filter(F.col("error").isNull()).drop("error")), refused.unionByName(failed)


def ask(states: DataFrame, state: str, question: str, kind: str, options: list[tuple[str, str]], out: str = "probs"
        ) -> DataFrame:
    """One literal question about a text column, decided by the built-in scorer: adds `options` and `probs`."""
    choices = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(d).alias("description")) for k, d in options])
    asked = states.withColumn("kind", F.lit(kind)).withColumn("question", F.lit(question)).withColumn("options", choices)
    return tournament(asked, "options", overlap_scorer(F.col(state)), out, most=len(options))


def register_functions(spark) -> None:
    """SQL functions. Native, inlined by the optimizer: retrieval_words(text), confidence(probs),
    option_probs(words of the state, options), decide(state, options), yes_no(state, yes, no), rate(state, levels), where
    options is an array of (key, description), date_mentions(text)."""
    stop = ", ".join("'" + w + "'" for w in fixed.STOP_WORDS)
    define = "CREATE OR REPLACE TEMPORARY FUNCTION "
    spark.sql(define + """confidence(p ARRAY<DOUBLE>) RETURNS DOUBLE RETURN
        CASE WHEN size(p) > 1 THEN round(greatest(0D, 1 - aggregate(p, 0D, (a, x) -> a + CASE WHEN x > 0
        THEN -x * ln(x) ELSE 0D END) / ln(size(p))), 4) ELSE 1D END""")
    spark.sql(define + f"date_mentions(t STRING) RETURNS ARRAY<{dates.MENTION}> RETURN " + dates.mentions_sql("t"))
    option = "ARRAY<STRUCT<key: STRING, description: STRING>>"
    words = f"""flatten(transform(regexp_extract_all(lower(<text>), r'{text.RUN}', 0), w -> CASE
        WHEN w RLIKE r'{fixed.NO_SPACE_CLASS}' THEN
            transform(sequence(1, greatest(1, length(w) - 1)), i -> substring(w, i, 2))
        WHEN array_contains(array({stop}), w) THEN CAST(array() AS ARRAY<STRING>)
        WHEN length(w) > 3 AND w LIKE '%s' AND w NOT LIKE '%ss' THEN array(substring(w, 1, length(w) - 1))
        ELSE array(w) END))"""
    spark.sql(define + "retrieval_words(t STRING) RETURNS ARRAY<STRING> RETURN " + words.replace("<text>", "t"))
    said = words.replace("<text>", "concat_ws(' ', regexp_replace(o.key, '_', ' '), o.description)")
    # one-element arrays bind a value, so that it is computed once
    probs = f"""transform(array(transform(array(array_distinct({words.replace('<text>', '<state>')})), seen -> transform(<options>,
        o -> exp(CAST(size(array_intersect(seen, {said})) AS DOUBLE))))[0]), e -> transform(e, x -> x / aggregate(e, 0D, (a, y) -> a + y)))[0]"""

    def with_options(options: str) -> str:
        return probs.replace("<state>", "state").replace("<options>", options)

    spark.sql(define + f"option_probs(state STRING, opts {option}) RETURNS ARRAY<DOUBLE> RETURN " + with_options("opts"))
    spark.sql(define + f"decide(state STRING, opts {option}) RETURNS STRING RETURN transform(array(" + with_options("opts")
              + "), p -> opts[CAST(array_position(p, array_max(p)) AS INT) - 1].key)[0]")
    yes_no = "array(named_struct('key', 'true', 'description', yes), named_struct('key', 'false', 'description', no))"
    spark.sql(define + "yes_no(state STRING, yes STRING, no STRING) RETURNS DOUBLE RETURN round((" + with_options(yes_no) + ")[0], 4)")
    levels = "transform(levels, (l, n) -> named_struct('key', CAST(n AS STRING), 'description', l))"
    spark.sql(define + "rate(state STRING, levels ARRAY<STRING>) RETURNS DOUBLE RETURN round(aggregate(transform("
              + with_options(levels) + ", (p, n) -> p * n), 0D, (a, x) -> a + x), 4)")
