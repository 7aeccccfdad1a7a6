"""Exact deduplication with a heavy-hitter split, in DataFrame functions only.

A frequent-items sketch (the Misra-Gries family: `approx_top_k`) names the digests that may be frequent; an exact count, summed
before any shuffle, verifies them and finds the row that stays. These few winners are broadcast, so that their copies, however many,
are settled where they are read. Only the remaining digests are shuffled, and none of those can be frequent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import SPACE
from plumbline.session import broadcast_if_small, materialise

WINNERS, TRACKED = 512, 8192


def digest(text: Column) -> Column:
    """SHA-256 (hex) of the text with each run of white space as one space; null counts as empty."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " "), 256)


def copies(docs: DataFrame, winners: int = WINNERS, tracked: int = TRACKED) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row. Of equal texts the row with the smallest doc_id stays (null
    ids come last); of rows with equal ids too, one stays. Null and empty texts are equal. Other columns are left out."""
    keyed = materialise(docs.select("doc_id", digest(docs["text"]).alias("text_sha256"), F.monotonically_increasing_id().alias("_row")), "digests")
    # the numbers are written, not made anew by each job: they follow splits, and those the cores that are alive at the time
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row"))
    candidates = keyed.select(F.expr(f"approx_top_k(text_sha256, {winners}, {tracked})").alias("top")).select(F.explode("top.item").alias("text_sha256"))
    heavy = (keyed.join(F.broadcast(candidates), "text_sha256", "left_semi")  # at most `winners` rows
             .groupBy("text_sha256").agg(first.alias("_first"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1"))
    heavy = materialise(heavy, "winners")
    settled = keyed.join(F.broadcast(heavy), "text_sha256")
    same = Window.partitionBy("text_sha256")
    rest = (keyed.join(F.broadcast(heavy), "text_sha256", "left_anti")
            .withColumn("_first", first.over(same)).withColumn("group_size", F.count(F.lit(1)).over(same)))
    return settled.unionByName(rest).select("doc_id", F.col("_first.doc_id").alias("keep_id"), "group_size", (F.col("_row") == F.col("_first._row")).alias("kept"), "text_sha256")


def deduplicate(docs: DataFrame, winners: int = WINNERS) -> DataFrame:
    """The rows of `docs`, all columns whatever their names, without the copies of another row (see `copies` for nulls and ties); an
    empty table gives no rows. Texts stay where they are: the copies of the `winners` largest groups go by their digest, which is
    broadcast, the others as (doc_id, digest), broadcast too if a count shows that they are few; only rows that repeat both
    are shuffled."""
    found = materialise(copies(docs), "copies")
    large = found.where("kept and group_size > 1").orderBy(F.desc("group_size"), "text_sha256").limit(winners)
    large = materialise(large.select(F.col("text_sha256").alias("_large"), F.col("keep_id").alias("_stays")), "largest")  # at most `winners` rows
    other = found.where("not kept").join(F.broadcast(large), F.col("text_sha256") == F.col("_large"), "left_anti")
    again = found.where(~F.col("kept") & F.col("doc_id").eqNullSafe(F.col("keep_id"))).select(F.col("doc_id").alias("_again"), F.col("text_sha256").alias("_same")).distinct()
    gone = other.where(~F.col("doc_id").eqNullSafe(F.col("keep_id"))).select(F.col("doc_id").alias("_gone"), F.col("text_sha256").alias("_sha")).distinct()
    again, gone = (materialise(x, "gone") for x in (again, gone))

    rows = docs.select(F.struct(*docs.columns).alias("_doc"), docs["doc_id"].alias("_id"), digest(docs["text"]).alias("_hash"))
    kept = rows.join(F.broadcast(large), F.col("_hash") == F.col("_large"), "left").where(F.col("_large").isNull() | F.col("_id").eqNullSafe(F.col("_stays")))
    kept = kept.join(broadcast_if_small(gone), F.col("_id").eqNullSafe(F.col("_gone")) & (F.col("_hash") == F.col("_sha")), "left_anti").select("_doc", "_id", "_hash")
    if again.head() is not None:
        same, again = F.col("_id").eqNullSafe(F.col("_again")) & (F.col("_hash") == F.col("_same")), broadcast_if_small(again)
        kept = kept.join(again, same, "left_anti").unionByName(kept.join(again, same, "left_semi").dropDuplicates(["_id", "_hash"]))
    return kept.select("_doc.*")
