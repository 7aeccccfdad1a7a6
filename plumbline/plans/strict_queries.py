"""Checks of assistant turns against what came before them in the conversation, and of pages and documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.functions import fixed, text
from plumbline.operators import strict
from plumbline.plans.registry import query
from plumbline.plans.retrieval_queries import sql_retrieval_words, sql_sentences
from plumbline.session import spread

# RE2 has neither look-behind nor look-ahead: the clock pattern uses ASCII word boundaries and the thousands comma is
# removed in two passes
SQL_CLOCK = r"(?i)\b([0-9]{1,2})(?::([0-9]{2}))?\s*([ap])\.?\s?m\b\.?"
SQL_LINK = r"(?i)(?:https?://|www\.)[^\s<>()\"'']+"


def sql_facts(col: str) -> str:
    a = f"regexp_replace({col}, '{fixed.EMAIL}', ' ', 'g')"
    b = f"regexp_replace({a}, '{SQL_LINK}', ' ', 'g')"
    c = f"regexp_replace({b}, '{SQL_CLOCK}', ' ', 'g')"
    plain = "regexp_replace(regexp_replace(m, ',([0-9]{3})([^0-9]|$)', '\\1\\2', 'g'), ',([0-9]{3})([^0-9]|$)', '\\1\\2', 'g')"
    return rf"""list_sort(list_distinct(list_concat(list_concat(
        list_transform(regexp_extract_all({col}, '{fixed.EMAIL}'), lambda m: rtrim(lower(m), '.,')),
        list_transform(regexp_extract_all({a}, '{SQL_LINK}'), lambda m: rtrim(regexp_replace(rtrim(lower(m), '.,;:!?'), '^(?:https?://)?(?:www\.)?', ''), '/'))),
        list_concat(list_transform(regexp_extract_all({b}, '{SQL_CLOCK}'), lambda m: CAST(CAST(regexp_extract(m, '{SQL_CLOCK}', 1) AS INTEGER) AS VARCHAR) || ':' ||
            coalesce(nullif(regexp_extract(m, '{SQL_CLOCK}', 2), ''), '00') || lower(regexp_extract(m, '{SQL_CLOCK}', 3)) || 'm'),
        list_transform(list_filter(list_transform(regexp_extract_all({c}, '{fixed.NUMBER}'), lambda m: {plain}), lambda m: length(regexp_replace(m, '[^0-9]', '', 'g')) >= 3),
            lambda m: CASE WHEN regexp_full_match(m, '[0-9]+\.[0-9]+') THEN rtrim(rtrim(m, '0'), '.') ELSE m END)))))"""


@query("document_facts", f"SELECT doc_id, array_to_string({sql_facts('text')}, ' | ') AS facts FROM documents")
def document_facts(t):
    return spread(t.documents).select("doc_id", F.array_join(F.array_sort(text.exact_facts(F.col("text"))), " | ").alias("facts"))


@query("page_facts", f"SELECT page_id, array_to_string({sql_facts('html')}, ' | ') AS facts FROM pages")
def page_facts(t):
    return spread(t.pages).select("page_id", F.array_join(F.array_sort(text.exact_facts(F.col("html"))), " | ").alias("facts"))


@query("facts_missing_from_pair", f"""WITH f AS (SELECT page_id, {sql_facts('html')} AS facts FROM pages)
    SELECT a.page_id, array_to_string(list_filter(a.facts, lambda x: NOT list_contains(coalesce(b.facts, []), x)), ' | ') AS missing
    FROM f a LEFT JOIN f b ON b.page_id = a.page_id - 1""")
def facts_missing_from_pair(t):
    """Exact facts of each page that the page before it does not contain."""
    now = t.pages.select("page_id", "html")
    before = t.pages.select((F.col("page_id") + 1).alias("page_id"), F.col("html").alias("source"))
    return now.join(before, "page_id", "left").select("page_id", F.array_join(text.unmatched_facts(
        F.col("html"), F.coalesce("source", F.lit(""))), " | ").alias("missing"))


def replies(t):
    """Assistant turns with what assistants said before as the knowledge, and the user's messages before. A conversation is one prompt,
    so it is small."""
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    said = lambda role: F.collect_list(F.when(F.col("role") == role, F.col("text"))).over(before)
    rows = t.conversations.withColumn("knowledge", F.array_join(said("assistant"), "\n")).withColumn("users", said("user"))
    return rows.filter(F.col("role") == "assistant").select(F.concat_ws("-", "conv_id", "turn").alias("reply_id"), F.col("text").alias("draft"), "knowledge", "users")


def clerk(rows, state, question, kind, options):
    """Stands in for a model that decides both questions. Kind: fewer than four words are no statement, a length that seven divides is an
    unknown, the rest are facts. Claim: supported as far as its words occur in the evidence."""
    s = F.substring(F.col(state), F.lit(len("Sentence: ") + 1), F.length(state))
    if question == fixed.SENTENCE_KIND_QUESTION:
        at = F.when(F.size(F.regexp_extract_all(s, F.lit("[^ ]+"), F.lit(0))) < 4, 2).when(F.length(s) % 7 == 0, 1).otherwise(0)
        return rows.withColumn("probs", F.transform(F.array(*[F.lit(i) for i in range(3)]), lambda i: F.when(i == at, 0.8).otherwise(0.1)))
    parts = F.split(F.substring(F.col(state), F.lit(len("Evidence:\n") + 1), F.length(state)), "\n\nClaim: ")
    words = [F.array_distinct(text.retrieval_words(F.get(parts, i))) for i in (0, 1)]
    share = F.when(F.size("_claim") == 0, 1.0).otherwise(F.size(F.array_intersect("_claim", "_known")) / F.size("_claim"))
    read = rows.select("*", F.explode_outer(F.array(F.struct(words[0].alias("_known"), words[1].alias("_claim")))).alias("_w")).select("*", "_w.*")
    return read.withColumn("probs", F.array(share, (1 - share) / 2, (1 - share) / 2)).drop("_w", "_known", "_claim")


REPLIES = """replies AS (SELECT conv_id || '-' || turn AS reply_id, text AS draft, coalesce(known, '') AS knowledge, coalesce(asked, '') AS users FROM (SELECT *,
        string_agg(text, chr(10) ORDER BY turn) FILTER (role = 'assistant') OVER w AS known, string_agg(text, chr(10) ORDER BY turn) FILTER (role = 'user') OVER w AS asked
        FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE role = 'assistant')"""
REPORT = rf"""{REPLIES}, parts AS (SELECT reply_id, unnest({sql_sentences('draft')}) AS sentence, generate_subscripts({sql_sentences('draft')}, 1) - 1 AS ord FROM replies),
    known AS (SELECT reply_id, {sql_facts("(knowledge || chr(10) || users)")} AS facts, {sql_retrieval_words('knowledge')} AS words FROM replies),
    judged AS (SELECT reply_id, ord, sentence, words, list_filter({sql_facts('sentence')}, lambda x: NOT list_contains(facts, x)) AS missing,
        CASE WHEN len(regexp_extract_all(sentence, '[^ ]+')) < 4 THEN 'other' WHEN length(sentence) % 7 = 0 THEN 'unknown' ELSE 'fact' END AS kind,
        list_distinct({sql_retrieval_words('sentence')}) AS claim FROM parts JOIN known USING (reply_id)),
    report AS (SELECT reply_id, ord, sentence, missing, kind, CASE WHEN len(missing) > 0 THEN 0.0::DOUBLE WHEN kind <> 'fact' THEN NULL WHEN len(claim) = 0 THEN 1.0::DOUBLE
        ELSE round(len(list_intersect(claim, words)) / len(claim), 4) END AS supported FROM judged)"""
SQL_NOTE = fixed.STRICT_NOTE.replace("'", "''")


@query("sentence_reports", f"WITH {REPORT} SELECT reply_id, CAST(ord AS BIGINT) AS ord, md5(sentence) AS sentence_md5, array_to_string(missing, ' | ') AS missing, kind, supported FROM report")
def sentence_reports(t):
    _, report = strict.verify(replies(t), "reply_id", clerk)
    return report.select("reply_id", F.col("ord").cast("bigint").alias("ord"), F.md5("sentence").alias("sentence_md5"), F.array_join("missing", " | ").alias("missing"), "kind", "supported")


def _sql_assemble(source: str, keys: str, untouched: str) -> str:
    return f"""kept AS (SELECT *, threshold IS NULL OR supported IS NULL OR supported >= threshold AS keep FROM {source}),
    grouped AS (SELECT {keys}, count(*) FILTER (NOT keep) AS removed, coalesce(string_agg(sentence, ' ' ORDER BY ord) FILTER (keep), '') AS said,
        coalesce(bool_or(keep AND supported IS NOT NULL), false) AS fact_left FROM kept GROUP BY {keys}),
    final AS (SELECT {keys}, removed, CASE WHEN removed = 0 THEN {untouched} WHEN fact_left THEN said || ' ' || '{SQL_NOTE}' ELSE '{SQL_NOTE}' END AS reply,
        CASE WHEN removed = 0 THEN 'sent' WHEN fact_left THEN 'trimmed' ELSE 'declined' END AS action FROM grouped)"""


@query("strict_replies", f"""WITH {REPORT}, timed AS (SELECT *, 0.5::DOUBLE AS threshold FROM report), {_sql_assemble('timed', 'reply_id', 'NULL')}
    SELECT r.reply_id, coalesce(f.action, 'sent') AS action, coalesce(f.removed, 0) AS removed, md5(coalesce(f.reply, r.draft)) AS reply_md5 FROM replies r LEFT JOIN final f USING (reply_id)""")
def strict_replies(t):
    done, _ = strict.verify(replies(t), "reply_id", clerk)
    return done.select("reply_id", "action", "removed", F.md5("reply").alias("reply_md5"))


@query("threshold_sweep", f"""WITH {REPORT}, timed AS (SELECT report.*, t.threshold FROM report, (VALUES (0.3::DOUBLE), (0.5), (0.7), (0.9), (NULL)) t(threshold)),
    {_sql_assemble('timed', 'reply_id, threshold', 'said')} SELECT coalesce(threshold, -1) AS threshold, action, count(*) AS replies, CAST(sum(removed) AS BIGINT) AS removed FROM final GROUP BY ALL""")
def threshold_sweep(t):
    _, report = strict.verify(replies(t), "reply_id", clerk)
    done = strict.sweep(report, "reply_id", [0.3, 0.5, 0.7, 0.9, None])
    return done.groupBy(F.coalesce("threshold", F.lit(-1.0)).alias("threshold"), "action").agg(F.count(F.lit(1)).alias("replies"), F.sum("removed").alias("removed"))
