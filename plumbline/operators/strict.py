"""Checking drafted replies, sentence by sentence, against the knowledge they were written from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import fixed, maths, text
from plumbline.operators import scoring
from plumbline.session import materialise


def checked_sentences(replies: DataFrame, key: str, draft: str = "draft", source: str = "source",
                      carry: list[str] | None = None) -> DataFrame:
    """One row per sentence: (key, ord, sentence, missing). `source` is the knowledge plus the user's own messages."""
    parts = replies.withColumn("_known", text.exact_facts(F.col(source))).select(
        key, *(carry or []), "_known", F.posexplode_outer(text.sentences(F.col(draft))).alias("ord", "sentence"))
    return parts.filter(F.col("sentence").isNotNull()).select(key, *(carry or []), "ord", "sentence", F.array_sort(F.array_except(
        text.exact_facts(F.col("sentence")), F.col("_known"))).alias("missing"))


def reports(sentences: DataFrame, kind: Column, supported: Callable[[DataFrame], DataFrame] | Column) -> DataFrame:
    """Sentence reports: `kind`, and `supported` for sentences that state a fact. A sentence with unmatched exact facts
    is a fact with support 0 and needs no claim check. `supported` is a column, or a function that takes the sentences
    still to check and returns them with a `supported` column (an outside scorer sees only those)."""
    marked = sentences.withColumn("kind", kind)
    is_fact = (F.col("kind") == "fact") | (F.size("missing") > 0)
    needs = (F.col("kind") == "fact") & (F.size("missing") == 0)
    if isinstance(supported, Column):
        return marked.withColumn("supported", F.when(F.size("missing") > 0, F.lit(0.0)).when(
            is_fact, F.round(supported, 4)))
    asked = supported(marked.filter(needs)).withColumn("supported", F.round("supported", 4))
    settled = marked.filter(~needs).withColumn("supported", F.when(F.size("missing") > 0, F.lit(0.0)))
    return asked.select(*settled.columns).unionByName(settled)


Ask = Callable[[DataFrame, str, str, str, list[tuple[str, str]]], DataFrame]


def verify(replies: DataFrame, key: str, ask: Ask | None = None, threshold: float | None = fixed.STRICT_THRESHOLD,
           note: str = fixed.STRICT_NOTE) -> tuple[DataFrame, DataFrame]:
    """(replies after the check, sentence reports) with both decisions made: first the kind of every sentence, then, only for
    sentences that state a fact and whose exact facts all occur, whether the knowledge supports it as a claim.

    `replies` has `key`, `draft`, `knowledge` and `users` (the user's own messages). Exact facts may come from the knowledge or the
    user; the evidence of a claim is the knowledge alone. `ask(rows, state, question, kind, options)` answers one question about a text
    column by adding `probs` in the order of `options`; by default the built-in scorer, as `scoring.ask`."""
    decide = ask or scoring.ask
    source = F.concat(F.col("knowledge"), F.lit("\n"), F.array_join("users", "\n"))
    rows = checked_sentences(replies.withColumn("source", source), key, carry=["knowledge"])

    def decided(part: DataFrame, state: Column, question: str, options: list[tuple[str, str]]) -> DataFrame:
        names = F.array(*[F.lit(k) for k, _ in options])
        done = decide(part.withColumn("_state", state), "_state", question, "choice", options)
        return done.withColumn("_top", F.element_at(names, maths.first_top(F.col("probs"))))

    kinds = decided(rows, F.concat(F.lit("Sentence: "), "sentence"), fixed.SENTENCE_KIND_QUESTION, fixed.SENTENCE_KINDS)
    sentences = materialise(kinds.select(*rows.columns, F.col("_top").alias("_kind")), "sentence_kinds")  # read by the second decision and the report

    def supported(open_ones: DataFrame) -> DataFrame:
        state = F.concat(F.lit("Evidence:\n"), "knowledge", F.lit("\n\nClaim: "), "sentence")
        at = [k for k, _ in fixed.CLAIM_OPTIONS].index("supported")
        done = decided(open_ones, state, fixed.CLAIM_QUESTION, fixed.CLAIM_OPTIONS)
        return done.select(*open_ones.columns, F.get("probs", at).alias("supported"))

    report = reports(sentences, F.col("_kind"), supported).drop("_kind", "knowledge")
    return assemble(replies, report, key, F.lit(threshold).cast("double"), note=note), report


def kept(threshold: Column) -> Column:
    """A sentence stays when it states no fact, its support reaches the threshold, or there is no threshold."""
    return threshold.isNull() | F.col("supported").isNull() | (F.col("supported") >= threshold)


def assemble(replies: DataFrame, report: DataFrame, key: str, threshold: Column, draft: str | None = "draft",
             note: str = fixed.STRICT_NOTE, by: list[str] | None = None) -> DataFrame:
    """(key, reply, action, removed) from sentence reports. Nothing removed: the draft with its line breaks (or the
    kept sentences when `draft` is None). Some fact left: the kept sentences and the note. None left: the note."""
    keys = [key, *(by or [])]
    rows = report.withColumn("_kept", kept(threshold))
    ordered = F.array_sort(F.collect_list(F.when(F.col("_kept"), F.struct("ord", "sentence"))))
    grouped = rows.groupBy(*keys).agg(
        F.transform(ordered, lambda s: s["sentence"]).alias("_sentences"),
        F.count_if(~F.col("_kept")).alias("removed"),
        F.max(F.col("_kept") & F.col("supported").isNotNull()).alias("_fact_left"))
    full = (replies.select(key, *([draft] if draft else [])).join(grouped, key, "left")
            .withColumn("removed", F.coalesce("removed", F.lit(0))))
    untouched = F.col(draft) if draft else F.array_join("_sentences", " ")
    return full.select(
        *keys, F.when(F.col("removed") == 0, F.coalesce(untouched, F.lit("")))
        .when(F.col("_fact_left"), F.array_join(F.concat("_sentences", F.array(F.lit(note))), " "))
        .otherwise(F.lit(note)).alias("reply"),
        F.when(F.col("removed") == 0, F.lit("sent")).when(F.col("_fact_left"), F.lit("trimmed"))
        .otherwise(F.lit("declined")).alias("action"), "removed")


def strict_check(replies: DataFrame, key: str, kind: Column, supported, threshold: float | None = fixed.STRICT_THRESHOLD,
                 note: str = fixed.STRICT_NOTE, carry: list[str] | None = None) -> DataFrame:
    """Replies after the check. `replies` has `key`, `draft`, `source` and the columns in `carry` that `kind` and
    `supported` read."""
    report = reports(checked_sentences(replies, key, carry=carry), kind, supported)
    return assemble(replies, report, key, F.lit(threshold).cast("double"), note=note)


def sweep(report: DataFrame, key: str, thresholds: list[float | None], note: str = fixed.STRICT_NOTE) -> DataFrame:
    """The same sentence reports assembled at several thresholds (None: no check), without scoring anything again.
    The thresholds are a literal array, so each report row is read once."""
    values = F.array(*[F.lit(t).cast("double") for t in thresholds])
    spread = report.withColumn("threshold", F.explode(values))
    ids = spread.select(key).distinct()
    return assemble(ids, spread, key, F.col("threshold"), draft=None, note=note, by=["threshold"])
