"""Leakage between documents, benchmark items and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import text
from plumbline.operators import leakage
from plumbline.session import spread
from plumbline.plans.registry import query, sql_shingles, sql_words


def _sets(t):
    return leakage.evaluation_sets(
        benchmark=t.benchmark.select("item_id", "text"),
        conversations=t.conversations.filter(F.col("role") == "user").select(
            F.concat_ws("-", "conv_id", "turn").alias("item_id"), "text"))


def flags(t):
    """Benchmark items and user turns against the documents."""
    return leakage.flag_items(leakage.shingle_hits(leakage.text_pool((t.documents, "text")), _sets(t)))


SETS = """items AS (
    SELECT 'benchmark' AS eval_set, CAST(item_id AS VARCHAR) AS item_id, text FROM benchmark
    UNION ALL SELECT 'conversations', conv_id || '-' || turn, text FROM conversations WHERE role = 'user')"""
FLAGS = f"""pool AS (SELECT {sql_words('text')} AS w FROM documents), {SETS},
    pool_grams AS (SELECT DISTINCT unnest({sql_shingles('w', 13)}) AS g FROM pool),
    pool_texts AS (SELECT DISTINCT array_to_string(w, ' ') AS x FROM pool),
    worded AS (SELECT eval_set, item_id, {sql_words('text')} AS w FROM items),
    item_grams AS (SELECT DISTINCT eval_set, item_id, unnest({sql_shingles('w', 13)}) AS g FROM worded),
    shares AS (SELECT i.eval_set, i.item_id, count(*) AS grams, count(p.g) AS hits
        FROM item_grams i LEFT JOIN pool_grams p ON i.g = p.g GROUP BY ALL),
    flags AS (SELECT w.eval_set, w.item_id, coalesce(s.grams, 0) AS grams, coalesce(s.hits, 0) AS hits,
            array_to_string(w.w, ' ') IN (SELECT x FROM pool_texts) AS exact,
            (array_to_string(w.w, ' ') IN (SELECT x FROM pool_texts)) OR coalesce(s.hits / s.grams >= 0.5, false) AS flagged
        FROM worded w LEFT JOIN shares s USING (eval_set, item_id) WHERE len(w.w) > 0)"""


@query("leakage_report", f"""WITH {FLAGS}
    SELECT eval_set, count(*) AS items, count(*) FILTER (exact) AS exact,
        count(*) FILTER (flagged) - count(*) FILTER (exact) AS near,
        round(count(*) FILTER (flagged) / count(*), 4) AS rate FROM flags GROUP BY eval_set""")
def leakage_report(t):
    return leakage.leakage_report(flags(t))


@query("gram_overlap", f"WITH {FLAGS} SELECT eval_set, item_id, grams, hits, exact, flagged FROM flags")
def gram_overlap(t):
    return flags(t)


@query("clean_items", f"""WITH {FLAGS} SELECT i.eval_set, i.item_id, length(i.text) AS n_chars FROM items i
    ANTI JOIN (SELECT * FROM flags WHERE flagged) f ON i.eval_set = f.eval_set AND i.item_id = f.item_id""")
def clean_items(t):
    kept = leakage.clean_items(_sets(t), flags(t), ["eval_set", "item_id"])
    return kept.select("eval_set", "item_id", F.length("text").cast("bigint").alias("n_chars"))


@query("leakage_by_source", f"""WITH pool AS (SELECT {sql_words('text')} AS w FROM benchmark),
    pool_grams AS (SELECT DISTINCT unnest({sql_shingles('w', 13)}) AS g FROM pool),
    pool_texts AS (SELECT DISTINCT array_to_string(w, ' ') AS x FROM pool),
    worded AS (SELECT source, lang, doc_id, {sql_words('text')} AS w FROM documents),
    grams AS (SELECT DISTINCT doc_id, unnest({sql_shingles('w', 13)}) AS g FROM worded),
    shares AS (SELECT doc_id, count(*) AS n, count(p.g) AS hits FROM grams d LEFT JOIN pool_grams p USING (g) GROUP BY doc_id),
    flags AS (SELECT w.source, w.lang, pt.x IS NOT NULL AS exact,
            pt.x IS NOT NULL OR coalesce(s.hits / s.n >= 0.5, false) AS flagged
        FROM worded w LEFT JOIN pool_texts pt ON pt.x = array_to_string(w.w, ' ') LEFT JOIN shares s USING (doc_id) WHERE len(w.w) > 0)
    SELECT source, lang, count(*) AS items, count(*) FILTER (exact) AS exact,
        count(*) FILTER (flagged) - count(*) FILTER (exact) AS near,
        round(count(*) FILTER (flagged) / count(*), 4) AS rate FROM flags GROUP BY source, lang""")
def leakage_by_source(t):
    hits = leakage.shingle_hits(leakage.text_pool((t.benchmark, "text")), t.documents.select(
        "source", "lang", "doc_id", "text"), keep=["source", "lang", "doc_id"], large_pool=False)
    return leakage.leakage_report(leakage.flag_items(hits), ["source", "lang"])


@query("exact_copies", f"""SELECT doc_id, source FROM documents WHERE source <> 'src0' AND len({sql_words('text')}) > 0 AND
    array_to_string({sql_words('text')}, ' ') IN (SELECT array_to_string({sql_words('text')}, ' ') FROM documents WHERE source = 'src0')""")
def exact_copies(t):
    """Documents of the other sources that repeat a text of the largest source."""
    other, first = t.documents.where("source <> 'src0'"), t.documents.where("source = 'src0'")
    return leakage.exact_copies(other.select("doc_id", "source", "text"), first).select("doc_id", "source")


@query("near_copies", f"""WITH d AS (SELECT DISTINCT doc_id, unnest({sql_shingles('w', 3)}) AS g
        FROM (SELECT doc_id, {sql_words('text')} AS w FROM documents WHERE source <> 'src0')),
    b AS (SELECT DISTINCT item_id, unnest({sql_shingles('w', 3)}) AS g
        FROM (SELECT doc_id AS item_id, {sql_words('text')} AS w FROM documents WHERE source = 'src0')),
    dn AS (SELECT doc_id, count(*) AS n FROM d GROUP BY 1), bn AS (SELECT item_id, count(*) AS n FROM b GROUP BY 1),
    pairs AS (SELECT doc_id, item_id, count(*) AS c FROM d JOIN b USING (g) GROUP BY 1, 2)
    SELECT doc_id, round(max(c / (dn.n + bn.n - c)), 6) AS jaccard
    FROM pairs JOIN dn USING (doc_id) JOIN bn USING (item_id) WHERE c / (dn.n + bn.n - c) >= 0.5 GROUP BY doc_id""")
def near_copies(t):
    """Documents of the other sources that are near a text of the largest source."""
    found = leakage.near_copies(t.documents.where("source <> 'src0'"), t.documents.where("source = 'src0'"), "doc_id")
    return found.select("doc_id", F.round("jaccard", 6).alias("jaccard"))


@query("near_copies_between_chats", f"""WITH d AS (SELECT DISTINCT doc_id, unnest({sql_shingles('w', 3)}) AS g
        FROM (SELECT conv_id * 100 + turn AS doc_id, {sql_words('text')} AS w FROM conversations)),
    b AS (SELECT DISTINCT item_id, unnest({sql_shingles('w', 3)}) AS g
        FROM (SELECT doc_id AS item_id, {sql_words('text')} AS w FROM documents)),
    dn AS (SELECT doc_id, count(*) AS n FROM d GROUP BY 1), bn AS (SELECT item_id, count(*) AS n FROM b GROUP BY 1),
    pairs AS (SELECT doc_id, item_id, count(*) AS c FROM d JOIN b USING (g) GROUP BY 1, 2)
    SELECT doc_id, round(max(c / (dn.n + bn.n - c)), 6) AS jaccard
    FROM pairs JOIN dn USING (doc_id) JOIN bn USING (item_id) WHERE c / (dn.n + bn.n - c) >= 0.5 GROUP BY doc_id""")
def near_copies_between_chats(t):
    turns = t.conversations.select((F.col("conv_id") * 100 + F.col("turn")).alias("doc_id"), "text")
    return leakage.near_copies(turns, t.documents, "doc_id").select("doc_id", F.round("jaccard", 6).alias("jaccard"))


@query("normalised_text", f"""SELECT doc_id, md5(array_to_string({sql_words('text')}, ' ')) AS norm_md5,
    len({sql_words('text')}) AS n_words FROM documents""")
def normalised_text(t):
    return (spread(t.documents).withColumn("w", text.words(F.col("text")))
            .select("doc_id", F.md5(F.array_join("w", " ")).alias("norm_md5"), F.size("w").cast("bigint").alias("n_words")))


@query("shingle_counts", f"""WITH w AS (SELECT doc_id, {sql_words('text')} AS w FROM documents)
    SELECT doc_id, len(list_distinct({sql_shingles('w', 13)})) AS grams_13, len(list_distinct({sql_shingles('w', 3)})) AS grams_3 FROM w""")
def shingle_counts(t):
    w = spread(t.documents).select("doc_id", text.words(F.col("text")).alias("w"))
    return w.select("doc_id", F.size(text.fingerprints(F.col("w"), 13)).cast("bigint").alias("grams_13"),
                    F.size(text.fingerprints(F.col("w"), 3)).cast("bigint").alias("grams_3"))


@query("page_text_facts", r"""WITH x AS (SELECT page_id, url, regexp_extract_all(url, '(?i)(?:https?://|www\.)[^\s<>()"'']+') AS links FROM pages)
    SELECT page_id, regexp_replace(regexp_replace(rtrim(lower(links[1]), '.,;:!?'), '^(?:https?://)?(?:www\.)?', ''), '/+$', '') AS link
    FROM x WHERE len(links) > 0""")
def page_text_facts(t):
    found = F.filter(text.exact_facts(F.col("url")), lambda f: f.rlike("[a-z]"))
    return t.pages.select("page_id", F.get(found, 0).alias("link")).filter("link is not null")
