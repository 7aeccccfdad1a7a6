"""Filters, labels, caps and mixes over training records."""

from __future__ import annotations

import difflib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import draws, fixed, maths, text
from plumbline.functions.binding import let
from plumbline.operators.leakage import near_copies
from plumbline.operators.ranking import positions, sample_fraction, sample_rows, shuffled, top_per_group
from plumbline.session import fits, materialise


# ---- row filters (columns) --------------------------------------------------------------------------------------------

def licence_decision(licence: Column) -> Column:
    """'used' when the licence text names a free licence and nothing that forbids use; else 'skipped'."""
    free = F.coalesce(licence.rlike(fixed.LICENCE_ALLOW) & ~licence.rlike(fixed.LICENCE_DENY), F.lit(False))
    return F.when(free, F.lit("used")).otherwise(F.lit("skipped"))


def refuses(reply: Column) -> Column:
    return reply.rlike(fixed.REFUSAL)


def states_answer(reply: Column, span: Column, translated: Column) -> Column:
    """The reply holds the verified span, or all of its numbers when question and reply were translated."""
    numbers = F.forall(text.digit_runs(span), lambda d: reply.contains(d))
    return F.when(translated, numbers).otherwise(F.lower(reply).contains(F.lower(span)))


def grounded_reply_kept(reply: Column, span: Column, translated: Column, says_unknown: Column | None = None) -> Column:
    """Answerable (span present): the answer is stated. Unanswerable: the reply declines, by pattern or, for other
    languages, by an outside verdict."""
    declines = refuses(reply) if says_unknown is None else F.when(translated, says_unknown).otherwise(refuses(reply))
    return F.when(F.coalesce(span, F.lit("")) != "", states_answer(reply, span, translated)).otherwise(declines)


def complete(finish_reason: Column) -> Column:
    return F.coalesce(finish_reason == "stop", F.lit(False))


def kept_reason(gold: Column, designed: Column, why: Column) -> Column:
    return F.when(gold == designed, why).otherwise(F.lit(""))


def top_label(probs: Column) -> Column:
    """(label, prob) of a map of label to probability; the first entry wins a tie."""
    return F.aggregate(F.map_entries(probs), F.struct(F.lit(None).cast("string").alias("label"),
                                                      F.lit(-1.0).alias("prob")),
                       lambda a, e: F.when(e["value"] > a["prob"], F.struct(e["key"].alias("label"),
                                                                            e["value"].alias("prob"))).otherwise(a))


# ---- similarity of two short texts -----------------------------------------------------------------------------------

@F.pandas_udf(T.DoubleType())
def _matching_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or b is None else difflib.SequenceMatcher(None, a.split(), b.split()).ratio()
                      for a, b in zip(left, right)], dtype="float64")


def similarity(left: Column, right: Column) -> Column:
    """Matching-blocks ratio of two word sequences: twice the words in matching blocks over all words."""
    return _matching_ratio(left, right)


def similarity_bound(left: Column, right: Column) -> Column:
    """A native upper bound of `similarity`: the multiset overlap of the words. Rows below a threshold here need no
    exact ratio."""
    a, b = F.split(text.strip(left), r"(?U)\s+"), F.split(text.strip(right), r"(?U)\s+")
    common = F.aggregate(F.array_distinct(a), F.lit(0), lambda n, w: n + F.least(
        F.size(F.filter(a, lambda x: x == w)), F.size(F.filter(b, lambda x: x == w))))
    return 2.0 * common / (F.size(a) + F.size(b))


# ---- templates --------------------------------------------------------------------------------------------------------

def validate_templates(drafts: DataFrame) -> DataFrame:
    """Checks drafted templates (tid, family, kind, domain, style, n, question, options, examples[input, gold],
    pairs[edit, input_a, gold_a, why_a, input_b, gold_b, why_b]). Adds `problems`; `pairs` keeps the valid pairs;
    `accepted` is false when the template as a whole fails. Similarities are exact only where the native bound leaves
    a doubt."""
    t = F.trim
    clean = drafts.withColumn("options", F.transform("options", lambda o: F.struct(
        t(o["key"]).alias("key"), t(o["description"]).alias("description"))))
    clean = clean.withColumn("_keys", F.transform("options", lambda o: o["key"]))
    clean = clean.withColumn("_ex", F.transform("examples", lambda e: F.struct(
        t(e["gold"]).alias("gold"), t(e["input"]).alias("state"))))
    # a repeated gold keeps its last example, as a mapping would
    clean = clean.withColumn("_ex", F.filter("_ex", lambda e, i: ~F.exists(
        F.slice("_ex", i + 2, F.size("_ex")), lambda later: later["gold"] == e["gold"])))
    keys_shown = F.concat(F.lit("["), F.array_join(F.transform("_keys", lambda k: F.concat(
        F.lit("'"), k, F.lit("'"))), ", "), F.lit("]"))
    bad_keys = ((F.size("_keys") != F.col("n")) | (F.size(F.array_distinct("_keys")) != F.size("_keys"))
                | ~F.forall("_keys", text.valid_key))
    bad_noul = (F.col("kind") == "noul") & (F.array_sort("_keys") != F.array(F.lit("false"), F.lit("true")))
    length_ok = lambda s: (F.length(s) >= 30) & (F.length(s) <= 700)
    bad_examples = ((F.array_sort(F.transform("_ex", lambda e: e["gold"])) != F.array_sort("_keys"))
                    | ~F.forall("_ex", lambda e: length_ok(e["state"])))
    fatal = (F.when(bad_keys, F.concat(F.lit("bad option keys "), keys_shown))
             .when(bad_noul, F.concat(F.lit("noul keys "), keys_shown))
             .when(bad_examples, F.lit("examples do not cover each option once")))
    clean = clean.withColumn("_fatal", fatal)
    rows = clean.select("tid", "_keys", "_ex", F.posexplode(F.when(F.col("_fatal").isNull(), F.col("pairs"))).alias("at", "p"))
    rows = rows.select("tid", "_keys", "_ex", "at", F.struct(*[t(F.col("p." + old)).alias(new) for old, new in [
        ("edit", "edit"), ("input_a", "a"), ("gold_a", "gold_a"), ("why_a", "why_a"), ("input_b", "b"),
        ("gold_b", "gold_b"), ("why_b", "why_b")]]).alias("p"))
    golds_bad = (~F.array_contains("_keys", F.col("p.gold_a")) | ~F.array_contains("_keys", F.col("p.gold_b"))
                 | (F.col("p.gold_a") == F.col("p.gold_b")))
    length_bad = ~(length_ok(F.col("p.a")) & length_ok(F.col("p.b"))) | (F.col("p.a") == F.col("p.b"))
    rows = rows.withColumn("_pre", F.when(golds_bad, F.concat(F.lit("golds "), F.col("p.gold_a"), F.lit("/"),
                                                              F.col("p.gold_b")))
                           .when(length_bad, F.lit("input length or identical")))
    rows = rows.withColumn("_ratio", similarity(F.when(F.col("_pre").isNull(), F.col("p.a")), F.col("p.b")))
    rows = rows.withColumn("_pre", F.coalesce("_pre", F.when(F.col("_ratio") < 0.35, F.concat(
        F.lit("edit too large ("), F.format_string("%.2f", "_ratio"), F.lit(")")))))
    near = (rows.filter(F.col("_pre").isNull()).select("tid", "at", "_ex", F.explode(F.array("p.a", "p.b")).alias("x"))
            .select("tid", "at", "x", F.explode("_ex.state").alias("e")))
    near = (near.filter(similarity_bound(F.col("x"), F.col("e")) > 0.9).filter(similarity(F.col("x"), F.col("e")) > 0.9)
            .select("tid", "at").distinct().withColumn("_copy", F.lit(True)))
    rows = rows.join(near, ["tid", "at"], "left").withColumn("_why", F.coalesce(
        "_pre", F.when(F.col("_copy"), F.lit("copies an example"))))
    judged = F.array_sort(F.collect_list(F.struct("at", "_why", "p")))
    grouped = rows.groupBy("tid").agg(judged.alias("_judged"))
    # each problem names the pair by the number of valid pairs before it
    problems = F.filter(F.transform("_judged", lambda r, i: F.when(r["_why"].isNotNull(), F.concat(
        F.lit("pair "), F.size(F.filter(F.slice("_judged", F.lit(1), i), lambda x: x["_why"].isNull())).cast("string"),
        F.lit(": "), r["_why"]))), lambda s: s.isNotNull())
    valid = F.transform(F.filter("_judged", lambda r: r["_why"].isNull()), lambda r: r["p"])
    out = clean.drop("pairs").join(grouped, "tid", "left").withColumn("pairs", valid)
    none_left = F.col("_fatal").isNull() & (F.coalesce(F.size("pairs"), F.lit(0)) <= 0)
    empty = F.array().cast("array<string>")
    return out.select(
        "tid", "family", "kind", "domain", "style", t(F.col("question")).alias("question"), "options",
        F.transform("_keys", lambda k: F.struct(F.get(F.filter("_ex", lambda e: e["gold"] == k), 0)["state"].alias("state"),
                                                k.alias("gold"))).alias("examples"), "pairs",
        F.when(F.col("_fatal").isNotNull(), F.array("_fatal")).otherwise(F.concat(
            F.coalesce(problems, empty), F.when(none_left, F.array(F.lit("no valid pairs"))).otherwise(empty))).alias("problems"),
        (F.col("_fatal").isNull() & ~none_left).alias("accepted"))


# ---- labelled templates to records ----------------------------------------------------------------------------------------

def halves(labelled: DataFrame) -> DataFrame:
    """One row per half of each contrastive pair: (template columns, pair, half, state, designed_gold, why, probs)."""
    base = ["tid", "family", "kind", "domain", "question", "options", "examples"]
    rows = labelled.select(*base, F.posexplode("pairs").alias("pair", "p"))
    both = F.array(*[F.struct(F.lit(h).alias("half"), F.col(f"p.{h}").alias("state"), F.col(f"p.gold_{h}").alias("designed_gold"),
                              F.col(f"p.why_{h}").alias("why"), F.col(f"p.teacher_{h}").alias("probs")) for h in "ab"])
    return rows.select(*base, "pair", F.col("p.edit").alias("edit"), F.explode(both).alias("h")).select(
        *base, "pair", "edit", "h.*")


def build_records(labelled: DataFrame, bench: DataFrame, val_percent: int = 5,
                  min_conf: float = fixed.MIN_CONFIDENCE) -> tuple[DataFrame, DataFrame]:
    """(records, stats). Templates that repeat a benchmark question or hold an example close to a benchmark text are
    left out; of the others, halves without a label, with low confidence, or close to a benchmark text are dropped. The
    label is the teacher's top answer; the written reason stays only where it explains that answer. `bench` has
    `text` and `question`."""
    asked = bench.select(F.lower(F.trim("question")).alias("q")).distinct()
    texts = bench.select("text")
    shown = labelled.select("tid", F.explode("examples.state").alias("text")).withColumn("xid", F.xxhash64("tid", "text"))
    close_examples = (near_copies(shown.select("xid", "text"), texts, "xid").select("xid"))
    bad = (labelled.withColumn("q", F.lower(F.trim("question"))).join(asked, "q", "left_semi").select("tid")
           .union(shown.join(close_examples, "xid", "left_semi").select("tid")).distinct().withColumn("bad", F.lit(True)))
    marked = labelled.join(bad, "tid", "left").withColumn("bad", F.coalesce("bad", F.lit(False)))
    items = halves(marked.filter(~F.col("bad"))).withColumn("top", top_label(F.col("probs")))
    items = items.withColumn("has", F.col("probs").isNotNull() & (F.coalesce(F.size("probs"), F.lit(0)) > 0))
    items = items.withColumn("low", F.col("has") & (F.col("top.prob") < min_conf))
    items = items.withColumn("id", F.concat_ws("-", "tid", F.concat(F.col("pair").cast("string"), F.col("half"))))
    close = near_copies(items.filter(F.col("has") & ~F.col("low")).select("id", F.col("state").alias("text")), texts,
                        "id").select("id", F.lit(True).alias("near"))
    items = items.join(close, "id", "left").withColumn("near", F.coalesce("near", F.lit(False)))
    items = items.withColumn("kept", F.col("has") & ~F.col("low") & ~F.col("near"))
    agree = F.col("top.label") == F.col("designed_gold")
    records = items.filter("kept").select(
        "id", "tid", "family", "kind", "domain", "question", "options", "examples", "state",
        F.col("top.label").alias("gold"), kept_reason(F.col("top.label"), F.col("designed_gold"), F.col("why")).alias("why"),
        F.col("probs").alias("teacher"), "edit", "designed_gold", draws.split_of(F.col("tid"), val_percent).alias("split"))
    pairs = items.groupBy("tid", "pair").agg(
        F.count(F.lit(1)).alias("n_in"), F.count_if("kept").alias("n_kept"), F.count_if("low").alias("n_low"),
        F.count_if(F.col("has") & ~F.col("low") & F.col("near")).alias("n_near"),
        F.count_if(F.col("kept") & ~agree).alias("n_over"),
        (F.count_if("kept") == 2).alias("both"),
        (F.min(F.when(F.col("kept"), F.col("top.label"))) != F.max(F.when(F.col("kept"), F.col("top.label")))).alias("differ"),
        F.first(draws.split_of(F.col("tid"), val_percent)).alias("split"))
    templates = pairs.groupBy("tid").agg(
        F.sum("n_in").alias("n_in"), F.sum("n_kept").alias("n_kept"), F.sum("n_low").alias("n_low"),
        F.sum("n_near").alias("n_near"), F.sum("n_over").alias("n_over"),
        F.count_if(F.col("both") & F.coalesce("differ", F.lit(False))).alias("n_pairs"), F.first("split").alias("split"))
    dropped = marked.filter("bad").agg(F.coalesce(F.sum(2 * F.size("pairs")), F.lit(0)).alias("dropped"))
    stats = templates.agg(
        F.count_if(F.col("n_kept") > 0).alias("templates"), F.sum("n_in").alias("items_in"),
        F.sum("n_kept").alias("items_kept"), F.sum("n_low").alias("low_confidence"),
        F.sum("n_over").alias("teacher_overrode_gold"), F.sum("n_pairs").alias("contrastive_pairs_kept"),
        F.sum("n_near").alias("near_items"),
        F.sum(F.when(F.col("split") == "train", F.col("n_kept"))).alias("train_items"),
        F.sum(F.when(F.col("split") == "val", F.col("n_kept"))).alias("val_items"))
    stats = stats.withColumn("contaminated", F.coalesce("near_items", F.lit(0)) + dropped.scalar()).drop("near_items")
    return records, stats.select(*[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in stats.columns])


# ---- public rows ----------------------------------------------------------------------------------------------------------

def tournament_options(rows: DataFrame, keys: list[str], group: int = fixed.GROUP_SIZE, seed: int = 0) -> DataFrame:
    """Rows with more than `group` options (array `options` of (key, description), map `teacher`) keep the gold option
    and `group - 1` others, drawn by hash, in a seeded order; the teacher distribution is renormalised over them.
    Adds `gold` (first top key). All inside the row."""
    out = rows.withColumn("gold", top_label(F.col("teacher"))["label"])
    ids = F.concat_ws(":", *[F.col(k).cast("string") for k in keys])
    mixed = draws.shuffle_array(F.filter("options", lambda o: o["key"] != F.col("gold")), seed, ids, lambda o: o["key"])
    few = F.concat(F.filter("options", lambda o: o["key"] == F.col("gold")), F.slice(mixed, 1, group - 1))
    many = F.size("options") > group
    out = out.withColumn("_few", draws.shuffle_array(few, f"{seed}-order", ids, lambda o: o["key"]))
    out = out.withColumn("teacher", F.when(many, maths.keep_keys(F.col("teacher"), F.transform("_few", lambda o: o["key"])))
                         .otherwise(F.col("teacher")))
    return out.withColumn("options", F.when(many, F.col("_few")).otherwise(F.col("options"))).drop("_few")


def soft_teacher(teacher: Column) -> Column:
    """The teacher distribution, or an empty map when it is as good as a hard label."""
    return F.when(maths.is_soft(F.map_values(teacher)), teacher).otherwise(
        F.create_map().cast("map<string,double>"))


def convert_public(rows: DataFrame, licences: DataFrame, banned: DataFrame, cap: int | Column, seed: int = 0) -> DataFrame:
    """Public cases to records: free licences only, test inputs out, a stable sample of at most `cap` cases per source,
    one tournament round per case, soft labels only where they are soft. `rows`: case_id, source, input_hash, kind,
    question, options, state, teacher; `licences`: source, licence. The licence filter runs before anything else."""
    free = licences.filter(licence_decision(F.col("licence")) == "used").select("source")
    allowed = rows.join(free, "source", "left_semi").join(banned, "input_hash", "left_anti")
    sampled = top_per_group(allowed, ["source"], [draws.rank_key(seed, F.col("case_id")), F.col("case_id")], cap,
                            ["case_id"]).drop("rank")
    short = tournament_options(sampled, ["source", "case_id"], seed=seed)
    return short.select(F.concat_ws("-", "source", "case_id").alias("tid"), F.col("source").alias("family"), "kind",
                        "question", "options", "state", "gold", soft_teacher(F.col("teacher")).alias("teacher"))


def source_manifest(licences: DataFrame) -> DataFrame:
    return licences.groupBy("source", "licence").agg(F.count(F.lit(1)).alias("rows")).withColumn(
        "decision", licence_decision(F.col("licence")))


# ---- caps and mixes -------------------------------------------------------------------------------------------------------

def cap_families(rows: DataFrame, key: str, cap: int = fixed.FAMILY_CAP, seed: int = 3, family: str = "family") -> DataFrame:
    """At most `cap` rows per family, the same ones in every run."""
    return top_per_group(rows, [family], [draws.rank_key(seed, F.col(key)), F.col(key)], cap, [key]).drop("rank")


def mix(public: DataFrame, own: DataFrame, key: str, cap: int = fixed.FAMILY_CAP, replay: float = fixed.REPLAY_SHARE,
        seed: int = 3, used: DataFrame | None = None, ordered: bool = True) -> DataFrame:
    """The training mix: capped public rows (without ids a previous round used, when `used` is given) and a replay
    share of own rows, shuffled."""
    fresh = public if used is None else public.join(used.select(key).distinct(), key, "left_anti")
    both = cap_families(fresh, key, cap, seed).unionByName(sample_fraction(own, [key], replay, seed),
                                                           allowMissingColumns=True)
    return shuffled(both, [key], seed) if ordered else both


def half_and_half(rows: DataFrame, key: str, flag: Column, n: int, seed: int = 0) -> DataFrame:
    """n // 2 rows where `flag` holds and n // 2 where it does not, however large n is."""
    marked = rows.withColumn("_flag", flag).where("_flag is not null")
    return sample_rows(marked, [key], n // 2, seed, ["_flag"]).drop("_flag")


def micro_batches(samples: DataFrame, key: str, length: str, micro: int = 8, pool: int = 16, seed: int = 0) -> DataFrame:
    """Length-sorted micro-batches: samples in a drawn order are cut into pools of exactly micro * pool, each pool is sorted by length
    and cut into batches, and the batches of all pools are shuffled by a second draw. Adds `pool`, `batch` (within the pool) and `step`
    (place of the batch in the run). Both orders are numbered by ranges, so no task sorts more than its range or a pool."""
    from pyspark.sql import Window
    drawn = positions(samples.withColumn("_draw", draws.rank_key(seed, F.col(key))), ["_draw", key], "_place")
    pooled = drawn.withColumn("pool", F.floor(F.col("_place") / (micro * pool)).cast("int"))
    inside = F.row_number().over(Window.partitionBy("pool").orderBy(length, "_draw", key)) - 1
    batched = pooled.withColumn("batch", F.floor(inside / micro).cast("int")).drop("_draw", "_place")
    batches = batched.select("pool", "batch").distinct().withColumn("_draw", draws.rank_key(seed, F.col("pool"), F.col("batch"), salt="batch"))
    steps = positions(batches, ["_draw", "pool", "batch"], "step").drop("_draw")
    return batched.join(steps, ["pool", "batch"]).select(*samples.columns, "pool", "batch", "step")


def held_out_from(rows: DataFrame, order: list[str | Column], first: int) -> DataFrame:
    """`position` of every row in the given order, and `held_out` for those from position `first` on: what one run uses and another
    must not see."""
    return positions(rows, order, "position").withColumn("held_out", F.col("position") >= first)


def filled_caps(rows: DataFrame, source: str, key: str, cap: int, convert: Callable[[DataFrame], DataFrame], seed: int = 0, spare: int = 3) -> DataFrame:
    """At most `cap` converted rows per source, and `cap` wherever the source has that many that can be converted. `convert` may drop rows
    and has to keep `source` and `key`. The first pass converts a stable sample of `spare` * `cap` rows per source; sources that come
    out short, and have rows left, are filled up from the next rows of the same order, each pass looking at twice as many. What a pass
    converted is written, so nothing is converted twice."""
    order = [draws.rank_key(seed, F.col(key)), F.col(key)]
    place = f"_rank_{key}"
    done, seen, size = None, 0, spare * cap
    while True:
        asked = rows if done is None else rows.join(open_ones, source, "left_semi")
        ranked = top_per_group(asked, [source], order, seen + size, [key], place).where(F.col(place) > seen)
        part = materialise(convert(ranked.drop(place)).join(ranked.select(F.col(source).alias("_s"), F.col(key).alias("_k"), place),
                                                            F.col(source).eqNullSafe(F.col("_s")) & (F.col(key) == F.col("_k"))).drop("_s", "_k"), "converted")
        done = part if done is None else done.unionByName(part)
        seen, size = seen + size, 2 * size
        have = done.groupBy(F.col(source).alias("_s")).agg(F.count(F.lit(1)).alias("_n"))
        all_of = rows.groupBy(source).agg(F.count(F.lit(1)).alias("_all"))
        open_ones = materialise(all_of.join(have, F.col(source).eqNullSafe(F.col("_s")), "left").where((F.coalesce("_n", F.lit(0)) < cap) & (F.col("_all") > seen)).select(source), "short_sources")
        if open_ones.head() is None:
            return top_per_group(done, [source], [F.col(place)], cap, [key], "_r").drop("_r", place)


def distractors(rows: DataFrame, contexts: DataFrame, key: str, doc: str, k: int = 3, seed: int = 0) -> DataFrame:
    """`k` passages from other documents for each row: (key, rank, doc of the passage, text); all others where there are fewer.
    Passages are numbered densely in a hashed order, bucket by bucket; a row draws a place and takes the passages from there
    on; where some of them are its own, it goes on from there."""
    from pyspark.sql import Window
    size = contexts.agg(F.count(F.lit(1)).alias("_n"))
    buckets = F.greatest(F.lit(1), F.floor(size.scalar() / 100_000)).cast("int")
    held = contexts.select(F.col(doc).alias("other"), F.col("text").alias("passage")).withColumn(
        "_in", draws.pick_index(seed, buckets, F.col("other"), salt="place"))
    before = Window.orderBy("_in").rowsBetween(Window.unboundedPreceding, -1)
    starts = held.groupBy("_in").agg(F.count(F.lit(1)).alias("_c")).select("_in", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("_in").orderBy(draws.rank_key(seed, F.col("other"), salt="place"), "other", "passage")
    held = held.withColumn("_no", F.row_number().over(within)).join(starts, "_in").withColumn("_at", F.col("_start") + F.col("_no") - 1)
    asked = rows.select(key, doc).withColumn("_n", size.scalar()).filter("_n > 0")
    first = F.floor(draws.unit(seed, F.col(key), salt="look") * F.col("_n"))
    open_ones, found, looked, step = materialise(asked.withColumn("_first", first), "looking"), None, 0, k
    held = materialise(held.select("_at", "other", "passage"), "places")
    while True:  # k places more for rows that are still short, then 2k, 4k, ...: only rows inside a long document of their own go on
        tried = open_ones.withColumn("_j", F.explode(F.sequence(F.lit(looked), F.least(F.col("_n"), F.lit(looked + step)) - 1)))
        met = tried.withColumn("_at", F.pmod(F.col("_first") + F.col("_j"), F.col("_n"))).join(held, "_at").filter(F.col("other") != F.col(doc)).select(key, "_j", "other", "passage")
        found = materialise(met if found is None else found.unionByName(met), "distractors")
        looked, step = looked + step, 2 * step
        have = found.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_have"))
        open_ones = materialise(open_ones.join(have, F.col(key) == F.col("_key"), "left").where((F.coalesce("_have", F.lit(0)) < k) & (F.col("_n") > looked)).drop("_key", "_have"), "looking")
        if open_ones.head() is None:
            return top_per_group(found, [key], [F.col("_j")], k, ["other"]).select(key, "rank", "other", "passage")


# ---- translations -----------------------------------------------------------------------------------------------------------

def carry_labels(records: DataFrame, translated: DataFrame, key: str = "id") -> DataFrame:
    """Records with translated text: `translated` has key, lang, full, state, examples (texts), question, options
    (descriptions), finish_reason. Rows that were cut off, have an empty text or lost a number are dropped; labels stay,
    the reason does not."""
    t = translated.select(key, "lang", "full", "finish_reason", F.col("state").alias("t_state"), F.col("examples").alias("t_ex"),
                          F.col("question").alias("t_q"), F.col("options").alias("t_opt"))
    both = records.drop("why").join(t, key)
    ok = lambda s, d: F.coalesce((text.strip(d) != "") & text.keeps_numbers(s, d), F.lit(False))
    texts = F.arrays_zip(F.transform("examples", lambda e: e["state"]).alias("s"), F.col("t_ex").alias("d"))
    said = F.arrays_zip(F.transform("options", lambda o: o["description"]).alias("s"), F.col("t_opt").alias("d"))
    good = (complete(F.col("finish_reason")) & ok(F.col("state"), F.col("t_state")) & F.forall(texts, lambda p: ok(p["s"], p["d"]))
            & (~F.col("full") | (ok(F.col("question"), F.col("t_q")) & F.forall(said, lambda p: ok(p["s"], p["d"])))))
    done = both.filter(good)
    return (done.withColumn("state", F.col("t_state"))
            .withColumn("examples", F.transform("examples", lambda e, i: F.struct(F.get("t_ex", i).alias("state"), e["gold"].alias("gold"))))
            .withColumn("question", F.when(F.col("full"), F.col("t_q")).otherwise(F.col("question")))
            .withColumn("options", F.when(F.col("full"), F.transform("options", lambda o, i: F.struct(
                o["key"].alias("key"), F.get("t_opt", i).alias("description")))).otherwise(F.col("options")))
            .withColumn("lang_scope", F.when(F.col("full"), F.lit("full")).otherwise(F.lit("input")))
            .drop("full", "finish_reason", "t_state", "t_ex", "t_q", "t_opt"))


# ---- plans for outside models ---------------------------------------------------------------------------------------------------

def language_draw(u_share: Column, u_pick: Column, share: float) -> Column:
    """A language drawn by weight with probability `share`, else null (English)."""
    names, weights = zip(*fixed.LANGUAGE_WEIGHTS)
    return F.when(u_share < share, draws.weighted_choice(u_pick, list(names), list(weights)))


DIMENSION_ROWS = 10_000


def weighted_join(rows: DataFrame, dim: DataFrame, weight: str, u: Column) -> DataFrame:
    """Draw one row of a dimension table per row, by weight. The dimension is a parameter table (languages, families), turned into
    cumulative ranges inside one array row, so nothing is compared pairwise; a table of more than DIMENSION_ROWS rows is refused."""
    if not fits(dim, DIMENSION_ROWS):
        raise ValueError(f"a dimension has at most {DIMENSION_ROWS} rows")
    entries = dim.agg(F.array_sort(F.collect_list(F.struct(*[F.col(c) for c in dim.columns]))).alias("_dim"))
    sums = F.aggregate("_dim", F.array().cast("array<double>"), lambda a, d: F.array_append(a, F.coalesce(F.get(a, F.size(a) - 1), F.lit(0.0)) + d[weight]))
    total = F.aggregate("_dim", F.lit(0.0), lambda a, d: a + d[weight])
    shelf = lambda v: F.floor(F.try_divide(v * F.size("_dim"), F.col("_total"))).cast("int")  # noqa: E731  # never falls as v grows
    # the sums of each shelf, and how many lie on shelves below: a draw is compared with the sums of its own shelf only
    held = entries.select("_dim", sums.alias("_sums"), total.alias("_total"))
    held = held.select("_dim", "_total", F.transform(F.sequence(F.lit(0), F.size("_dim")), lambda b: F.struct(
        F.size(F.filter("_sums", lambda s: shelf(s) < b)).alias("below"), F.filter("_sums", lambda s: shelf(s) == b).alias("own"))).alias("_shelves"))
    held = materialise(held, "dimension")
    drawn = rows.withColumn("_part", u).crossJoin(F.broadcast(held))
    # a generator's output is not inlined into the lambda below, which would draw once per sum
    drawn = drawn.select(*rows.columns, "_dim", "_shelves", "_total", F.explode_outer(F.array(F.col("_part") * F.col("_total"))).alias("_u"))
    own = F.get("_shelves", shelf(F.col("_u")))
    at = let(own, lambda s: s["below"] + F.size(F.filter(s["own"], lambda x: x <= F.col("_u"))))
    at = F.least(F.when(F.col("_total") == 0, F.size("_dim")).otherwise(F.coalesce(at, F.lit(0))), F.size("_dim") - 1)
    return drawn.select(*rows.columns, F.explode_outer(F.array(F.get("_dim", at))).alias("_d")).select(
        *rows.columns, *[F.col(f"_d.{c}").alias(c) for c in dim.columns])


def chat_jobs(prompts: DataFrame, at: str = "i") -> DataFrame:
    """The interleaved job list: every prompt asks for a general answer, every third (from 1) also for a knowledge base,
    every third (from 0) also for a summary: (at, job, id)."""
    jobs = F.when(F.pmod(at, F.lit(3)) == 1, F.array(F.lit("g"), F.lit("k"))).when(
        F.pmod(at, F.lit(3)) == 0, F.array(F.lit("g"), F.lit("s"))).otherwise(F.array(F.lit("g")))
    return prompts.withColumn("job", F.explode(jobs)).withColumn("id", F.concat("job", F.col(at).cast("string")))


def remaining(plan: DataFrame, *done: DataFrame, key: str = "id") -> DataFrame:
    """Rows of a plan whose id is in none of the finished or rejected tables."""
    ids = None
    for part in done:
        one = part.select(key)
        ids = one if ids is None else ids.union(one)
    return plan if ids is None else plan.join(ids.distinct(), key, "left_anti")


def plan_templates(n: int, families: DataFrame, domains: DataFrame, styles: DataFrame, edits: DataFrame, spark, seed: int = 1,
                   start: int = 0) -> DataFrame:
    """Template specs: one row per index with a family (drawn by `weight`), domain, style, option count, pair count and
    that many different edits. The dimensions are parameter tables: families (family, kind, what, hint, weight),
    domains (domain, weight), styles (style, weight), edits (edit, weight)."""
    i = F.col("i")
    specs = spark.range(start, start + n).withColumnRenamed("id", "i")
    out = weighted_join(specs, families, "weight", draws.unit(seed, i, salt="family")).drop("weight")
    out = weighted_join(out, domains, "weight", draws.unit(seed, i, salt="domain")).drop("weight")
    out = weighted_join(out, styles, "weight", draws.unit(seed, i, salt="style")).drop("weight")
    listed = F.regexp_extract(F.trim(F.substring_index("hint", ",", 1)), r"^[a-z_]+( / [a-z_]+)+$", 0)
    lo = F.regexp_extract("hint", r"(\d+)-(\d+)", 1).try_cast("int")
    hi = F.regexp_extract("hint", r"(\d+)-(\d+)", 2).try_cast("int")
    u = draws.unit(seed, i, salt="options")
    count = (F.when(F.col("kind") == "noul", F.lit(2)).when(listed != "", F.size(F.split(listed, " / ")))
             .when(lo.isNotNull(), (lo + F.floor(u * (hi - lo + 1))).cast("int"))
             .when(F.col("kind") == "score", (4 + F.floor(u * 2)).cast("int")).otherwise((3 + F.floor(u * 3)).cast("int")))
    out = out.withColumn("n", count).withColumn("k", (4 + F.floor(draws.unit(seed, i, salt="pairs") * 3)).cast("int"))
    held = edits.agg(F.collect_set("edit").alias("_edits"))
    return out.withColumn("_edits", held.scalar()).withColumn("edits", F.slice(draws.shuffle_array(F.array_sort("_edits"), seed, i, lambda e: e), F.lit(1), F.col("k"))
                          ).withColumn("tid", F.concat(F.lit(f"s{seed}-"), F.when(i < 1_000_000, F.lpad(i.cast("string"), 6, "0")).otherwise(i.cast("string")))).drop("_edits")


# ---- training samples -----------------------------------------------------------------------------------------------------------

def training_samples(records: DataFrame, seed: int = 0, zero_shot: float = fixed.ZERO_SHOT_SHARE,
                     explain: float = fixed.EXPLAIN_SHARE, default_criteria: float = 0.0, iso_dates: bool = False,
                     max_words: int | None = None) -> DataFrame:
    """Records to model input: options and examples in a seeded order, a share shown without examples, a share asked to
    explain (only where a reason exists), a share of yes/no rows with the default descriptions. Adds `messages`,
    `shown_keys`, `answer` (letter) and `tail` (reason or empty). `max_words` drops samples that are too long."""
    from plumbline.functions import dates, prompts
    i = F.col("id")
    yes_no = F.array_sort(F.transform("options", lambda o: o["key"])) == F.array(F.lit("false"), F.lit("true"))
    plain = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(d).alias("description")) for k, d in (
        ("true", fixed.YES_DEFAULT), ("false", fixed.NO_DEFAULT))])
    out = records.withColumn("_o", F.when(yes_no & (draws.unit(seed, i, salt="default") < default_criteria), plain).otherwise(
        draws.shuffle_array(F.col("options"), seed, i, lambda o: o["key"])))
    shots = F.when(draws.unit(seed, i, salt="zero") >= zero_shot, draws.shuffle_array(
        F.col("examples"), seed, i, lambda e: F.concat_ws("|", e["gold"], e["state"]))).otherwise(F.slice("examples", 1, 0))
    out = out.withColumn("_e", shots)
    found = dates.date_facts(F.col("state"), iso_dates)
    out = out.withColumn("_f", found)
    texts = F.transform("_e", lambda e: e["state"])
    out = out.withColumn("_ef", F.transform(texts, lambda t: dates.date_facts(t, True)) if iso_dates else dates.facts_each(texts))
    shown = F.transform("_e", lambda e, n: F.struct(prompts.json_string(e["state"]).alias("state_json"),
                                                    F.get(F.col("_ef"), n).alias("facts"), e["gold"].alias("gold")))
    asks = (draws.unit(seed, i, salt="explain") < explain) & (F.coalesce(text.strip(F.col("why")), F.lit("")) != "")
    body = prompts.decision_body(F.col("question"), F.col("_o"), prompts.json_string(F.col("state")), F.col("_f"), shown)
    out = (out.withColumn("explained", asks).withColumn("messages", prompts.decision_messages(body, F.col("explained")))
           .withColumn("shown_keys", F.transform("_o", lambda o: o["key"])).withColumn("answer", prompts.letter_of(F.col("_o"), F.col("gold")))
           .withColumn("tail", F.when(F.col("explained"), F.concat(F.lit("\n"), text.strip(F.col("why")))).otherwise(F.lit("")))
           .drop("_o", "_e", "_f", "_ef"))
    if max_words is not None:
        words = text.rough_words(F.concat_ws(" ", F.transform("messages", lambda m: m["content"]), F.col("tail")))
        out = out.filter(words <= max_words)
    return out


def chat_samples(chats: DataFrame, max_words: int | None = None) -> DataFrame:
    """Chat rows (messages or prompt, response, truncated) to (id, messages, response, ends): a cut-off answer carries no
    end-of-turn."""
    from plumbline.functions import prompts
    msgs = F.coalesce("messages", F.array(prompts.message("user", F.col("prompt"))))
    out = chats.select("id", msgs.alias("messages"), "response", (~F.coalesce("truncated", F.lit(False))).alias("ends"))
    if max_words is not None:
        out = out.filter(text.rough_words(F.concat_ws(" ", F.transform("messages", lambda m: m["content"]), F.col("response"))) <= max_words)
    return out


def mixed_stream(decisions: DataFrame, chats: DataFrame, share: float, key: str = "id", seed: int = 0) -> DataFrame:
    """A stream in which about `share` of the samples are chats: every slot of the decision stream draws whether a chat
    goes in front of it; the chat for a slot is picked by index, so one chat can be used more than once, as with
    drawing with replacement. `chats` is indexed inside hash buckets, no global order is needed."""
    from pyspark.sql import Window
    quota = share / (1 - share)
    slots = decisions.select(F.col(key).cast("string").alias("slot")).withColumn(
        "_k", (F.floor(F.lit(quota)) + (draws.unit(seed, F.col("slot"), salt="chat") < quota - int(quota)).cast("int")).cast("int"))
    size = chats.agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) / 1000)).cast("int").alias("_b"))
    held = chats.withColumn("_b", size.scalar()).withColumn("_at", draws.pick_index(seed, F.col("_b"), F.col(key), salt="at"))
    held = held.withColumn("_no", F.row_number().over(Window.partitionBy("_at").orderBy(key)) - 1)
    counts = held.groupBy("_at").agg(F.count(F.lit(1)).cast("int").alias("_n"))
    wanted = slots.filter("_k > 0").withColumn("_j", F.explode(F.sequence(F.lit(1), "_k"))).withColumn("_b", size.scalar())
    wanted = wanted.withColumn("_at", draws.pick_index(seed, F.col("_b"), F.col("slot"), F.col("_j"), salt="bucket"))
    wanted = wanted.join(counts, "_at").withColumn("_no", draws.pick_index(seed, F.col("_n"), F.col("slot"), F.col("_j"), salt="no"))
    drawn = wanted.select("slot", "_j", "_at", "_no").join(held.select("_at", "_no", F.col(key).cast("string").alias("sample")), ["_at", "_no"])
    chat_rows = drawn.select("slot", "sample", F.lit("chat").alias("stream"))
    own = decisions.select(F.col(key).cast("string").alias("slot"), F.col(key).cast("string").alias("sample"), F.lit("decision").alias("stream"))
    return own.unionByName(chat_rows)
