"""Mixing sources to target weights by entropy balancing, in DataFrame functions only.

Every document gets a rate, the expected number of its copies. Among all rates of at most `most` whose tokens add up to each source's
target, entropy balancing takes those nearest to 1 in relative entropy: sum(r * log(r) - r) is least. Its dual is convex, one number a
source, and its solution tilts documents exponentially: r = min(most, exp(lambda * size / scale)). Newton steps find the numbers: each is one
aggregate over the histogram of (source, size), with the log of the tokens reached as the equation and a bracket that halves the
interval where a step would leave it. All sums are of whole numbers, so that reruns agree whatever the order of rows.

Rates become copies per class of equal source and size: running totals of expected copies, from the largest size down, are rounded, which
leaves each source within half of its largest document; a few copies of the size that is missing, added, taken or moved to the next size,
then bring it to a few words. Inside
a class the copies are dealt by hashed doc_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import SPACE
from plumbline.operators.ranking import positions
from plumbline.session import materialise

WEIGHTS, MOST = (5, 2, 1), 3
STEPS, ENOUGH, REPAIRS = 200, 0.25, 4
UNIT = 1024.0  # tokens are summed in whole parts of 1/1024


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^" + SPACE[1:])), F.lit(0)).cast("long")


def sized(docs: DataFrame, source: str = "source") -> DataFrame:
    """doc_id, key, size of every row. Keys sort as the sources do by code point, with the null source last."""
    key = F.coalesce(F.concat(F.lit("s"), docs[source].cast("string")), F.lit("t"))
    return docs.select(docs["doc_id"], key.alias("key"), word_count(docs["text"]).alias("size"))


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """`sources` (key, source_size, ...) with `target`: all tokens shared by the repeating weights; a target above `most` times its
    source's size stops there and the excess is shared by weight among the others, until none is above. The level (tokens per weight)
    only rises, so the loop ends; each round is one aggregate over the sources."""
    ranked = positions(sources, ["key"], "_rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    weighted = materialise(ranked.withColumn("_weight", weight).drop("_rank"), "sources")
    cap, level, before = most * F.col("source_size"), 0.0, None
    total = weighted.agg(F.sum("source_size")).first()[0] or 0
    while before != level:
        before = level
        above = F.lit(level) * F.col("_weight") > cap
        held, free = weighted.agg(F.coalesce(F.sum(F.when(above, F.col("source_size"))), F.lit(0)), F.sum(F.when(~above, F.col("_weight")))).first()
        level = max(level, (total - most * held) / free) if free else level
    return weighted.withColumn("target", F.least(cap.cast("double"), F.lit(level) * F.col("_weight"))).drop("_weight")


def rate(most: float) -> Column:
    return F.least(F.lit(float(most)), F.exp(F.least(F.lit(700.0), F.col("tilt") * F.col("size") / F.col("scale"))))


def balanced(histogram: DataFrame, sources: DataFrame, most: float = MOST) -> DataFrame:
    """key, target, source_size, scale, tilt: the dual solution of each source. `histogram` is key, size, n (documents); `sources` has key,
    source_size, target, squares (sum of squared sizes), least (smallest size above 0). A source without words gets tilt 0."""
    unset = F.lit(None).cast("double")
    full = F.col("target") >= most * F.col("source_size")  # every document as often as may be
    scale = F.when(F.col("source_size") > 0, F.col("squares") / F.col("source_size")).otherwise(1.0)
    end = F.log(F.lit(float(most))) * F.col("scale") / F.col("least")  # here every rate has reached `most`
    state = (sources.withColumn("scale", scale).withColumn("high", F.when(F.col("source_size") > 0, end))
             .select("key", "source_size", "target", "scale", F.when(full & (F.col("source_size") > 0), F.col("high")).otherwise(0.0).alias("tilt"),
                     unset.alias("low"), "high", (full | (F.col("source_size") == 0)).alias("done")))
    state = materialise(state, "tilts")
    words = histogram.where("size > 0")
    kept = ["source_size", "target", "scale", "tilt", "low", "high", "done"]
    whole = lambda x: F.sum(F.round(x * UNIT).cast("long")) / UNIT
    for _ in range(STEPS):
        if state.where("not done").head() is None:
            return state.select("key", "source_size", "target", "scale", "tilt")
        r, tokens = rate(most), F.col("n") * F.col("size")
        sums = (words.join(state.where("not done"), "key").groupBy("key").agg(
            *[F.first(c).alias(c) for c in kept], whole(tokens * r).alias("reached"), whole(F.when(r < most, tokens * r * F.col("size") / F.col("scale")).otherwise(0.0)).alias("slope")))
        off = F.col("reached") - F.col("target")
        low, high = F.when(off < 0, F.col("tilt")).otherwise(F.col("low")), F.when(off > 0, F.col("tilt")).otherwise(F.col("high"))
        newton = F.col("tilt") + F.try_divide(F.log(F.try_divide(F.col("target"), F.col("reached"))) * F.col("reached"), F.col("slope"))
        inside = (F.col("slope") > 0) & (F.col("reached") > 0) & (newton < F.col("high")) & (F.col("low").isNull() | (newton > F.col("low")))
        halved = F.coalesce((F.col("low") + F.col("high")) / 2, F.col("high") - 1)
        ended = (F.abs(off) <= F.greatest(F.lit(ENOUGH), F.col("target") * 1e-9)) | F.coalesce(F.col("high") - F.col("low") <= F.abs("high") * 1e-14, F.lit(False))
        moved = (sums.withColumn("low", low).withColumn("high", high).withColumn("done", ended)
                 .withColumn("tilt", F.when(F.col("done"), F.col("tilt")).when(inside, newton).otherwise(halved)))
        state = materialise(moved.select("key", *kept).unionByName(state.where("done")), "tilts")
    raise RuntimeError("a source's tilt was not found")


def whole_copies(classes: DataFrame, most: int = MOST) -> DataFrame:
    """`classes` (key, size, n, rate, target) with `copies` (long): how many copies the class gives in all, at most `most` a document."""
    down = Window.partitionBy("key").orderBy(F.desc("size"))
    same, room = Window.partitionBy("key"), F.col("n") * int(most)
    upto = F.sum(F.col("n") * F.col("rate")).over(down.rowsBetween(Window.unboundedPreceding, 0))
    rounded = classes.withColumn("_upto", F.round(upto).cast("long"))
    out = rounded.withColumn("copies", F.greatest(F.lit(0), F.least(room, F.col("_upto") - F.coalesce(F.lag("_upto").over(down), F.lit(0))))).drop("_upto")
    smaller = lambda c: F.lead(c).over(down)
    for step in ["copy"] * REPAIRS + ["move"] * REPAIRS:
        out = out.withColumn("_off", F.col("target") - F.sum(F.col("copies") * F.col("size")).over(same))
        more = F.col("_off") > 0
        if step == "copy":  # one copy more or less of a size
            gain, can = F.col("size"), F.when(more, F.col("copies") < room).otherwise(F.col("copies") > 0)
        else:  # one copy from the next smaller size to this one, or back
            gain = F.col("size") - smaller("size")
            can = F.when(more, (F.col("copies") < room) & (smaller("copies") > 0)).otherwise((F.col("copies") > 0) & (smaller("copies") < smaller(room)))
        out = out.withColumn("_gain", gain).withColumn("_can", F.coalesce(can, F.lit(False)) & (F.col("_gain") > 0) & (F.col("_gain") < 2 * F.abs("_off")))
        nearest = F.min(F.when(F.col("_can"), F.struct(F.abs(F.abs("_off") - F.col("_gain")).alias("d"), "size"))).over(same)
        out = out.withColumn("_pick", nearest["size"])
        change = F.when(F.col("size") == F.col("_pick"), F.signum("_off"))
        if step == "move":
            change = change.when(F.lag("size").over(down) == F.col("_pick"), -F.signum("_off"))
        out = out.withColumn("copies", F.col("copies") + F.coalesce(change.cast("long"), F.lit(0))).drop("_off", "_gain", "_can", "_pick")
    return out


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST, source: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, taken, copies, rate for every row: `taken` = `copies` * `size` words go into the mix.

    Null and empty texts have size 0 and give nothing; a null source is a source of its own, the last one. Rows with equal source and size
    are told apart by hashed doc_id, rows with equal ids too in any order (their results are alike). Other columns are left out, whatever
    their names; an empty table gives no rows. A third of all rows in one source or class stays spread: classes are
    counted before any shuffle and numbered by ranges; a window holds the distinct sizes of one source, whose number grows with
    the square root of its words at most."""
    rows = materialise(sized(docs, source), "sizes")
    histogram = materialise(rows.groupBy("key", "size").agg(F.count(F.lit(1)).alias("n")), "sizes_of_sources")
    tokens = F.col("n") * F.col("size")
    sources = histogram.groupBy("key").agg(F.sum(tokens).alias("source_size"), F.sum(tokens.cast("double") * F.col("size")).alias("squares"),
                                           F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least"))
    tilts = balanced(histogram, materialise(targets(sources, weights, most), "targets"), most)
    rated = histogram.join(tilts, "key").withColumn("rate", rate(most))
    classes = whole_copies(rated, most).select(F.col("key").alias("_key"), F.col("size").alias("_size"), "n", "copies", "source_size", "target", "rate")
    placed = positions(rows.withColumn("_hash", F.xxhash64("doc_id")), ["_hash", "doc_id"], "_at", ["key", "size"])
    times = (F.floor(F.col("copies") / F.col("n")) + (F.col("_at") < F.col("copies") % F.col("n")).cast("int")).cast("int")
    return (placed.join(classes, (F.col("key") == F.col("_key")) & (F.col("size") == F.col("_size")))
            .select("doc_id", "size", "source_size", "target", (times * F.col("size")).alias("taken"), times.alias("copies"), "rate"))
