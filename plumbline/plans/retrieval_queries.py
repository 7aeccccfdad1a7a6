"""Passages, ranking and grounded prompts: documents are the knowledge (one corpus per language), conversations ask."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import fixed, prompts, text
from plumbline.operators import retrieval
from plumbline.plans.registry import query, sql_strip
from plumbline.session import spread

STOP = ", ".join(f"'{w}'" for w in fixed.STOP_WORDS)
NO_SPACE = fixed.NO_SPACE_CLASS


def sql_retrieval_words(col: str) -> str:
    return rf"""flatten(list_transform(regexp_extract_all(lower({col}), '[\p{{L}}\p{{N}}\p{{M}}]+'), lambda w: CASE
        WHEN regexp_matches(w, '{NO_SPACE}') THEN list_transform(range(1, greatest(1, length(w) - 1) + 1), lambda i: substr(w, i, 2))
        WHEN w IN ({STOP}) THEN []
        WHEN length(w) > 3 AND w LIKE '%s' AND w NOT LIKE '%ss' THEN [substr(w, 1, length(w) - 1)] ELSE [w] END))"""


def sql_count(col: str) -> str:
    return rf"(CASE WHEN regexp_matches({col}, '{NO_SPACE}') THEN greatest(len(regexp_extract_all({col}, '[^\s]+')), length({col}) // 2) ELSE len(regexp_extract_all({col}, '[^\s]+')) END)"


def sql_sentences(col: str) -> str:
    return (rf"list_filter(list_transform(string_split(replace(regexp_replace(regexp_replace({col}, '([.!?])\s+', '\1' || chr(1), 'g'), '([。！？])', '\1' || chr(1), 'g'), chr(10), chr(1)), chr(1)), "
            rf"lambda s: {sql_strip('s')}), lambda s: s <> '')")


PASSAGES = rf"""RECURSIVE paras AS (SELECT doc_id, lang, source, unnest(list_filter(list_transform(string_split(regexp_replace(text, '\n\s*\n', chr(2), 'g'), chr(2)),
        lambda s: {sql_strip('s')}), lambda s: s <> '')) AS p, generate_subscripts(list_filter(list_transform(string_split(regexp_replace(text, '\n\s*\n', chr(2), 'g'), chr(2)),
        lambda s: {sql_strip('s')}), lambda s: s <> ''), 1) AS pn FROM documents),
    split AS (SELECT doc_id, lang, source, pn, CASE WHEN {sql_count('p')} > 120 THEN list_filter(string_split(regexp_replace(regexp_replace(p, '([.!?])\s+', '\1' || chr(1), 'g'), '([。！？])', '\1' || chr(1), 'g'), chr(1)),
        lambda s: s <> '') ELSE [p] END AS us FROM paras),
    units AS (SELECT doc_id, lang, source, u, {sql_count('u')} AS n, row_number() OVER (PARTITION BY doc_id ORDER BY pn, un) AS i
        FROM (SELECT doc_id, lang, source, pn, unnest(us) AS u, generate_subscripts(us, 1) AS un FROM split)),
    pack(doc_id, i, n, passage) AS (SELECT doc_id, i, n, 0 FROM units WHERE i = 1
        UNION ALL SELECT u.doc_id, u.i, CASE WHEN p.n > 0 AND p.n + u.n > 120 THEN u.n ELSE p.n + u.n END, CASE WHEN p.n > 0 AND p.n + u.n > 120 THEN p.passage + 1 ELSE p.passage END
        FROM pack p JOIN units u ON u.doc_id = p.doc_id AND u.i = p.i + 1),
    passages AS (SELECT u.doc_id, any_value(u.lang) AS lang, passage, any_value(u.source) || ': ' || string_agg(u.u, chr(10) ORDER BY u.i) AS text, CAST(sum(u.n) AS BIGINT) AS n_words
        FROM units u JOIN pack p ON u.doc_id = p.doc_id AND u.i = p.i GROUP BY u.doc_id, passage)"""
INDEXED = f"""worded AS (SELECT lang, doc_id, passage, {sql_retrieval_words('text')} AS w FROM passages),
    tf AS (SELECT lang, doc_id, passage, term, count(*) AS tf FROM (SELECT lang, doc_id, passage, unnest(w) AS term FROM worded) GROUP BY ALL),
    stats AS (SELECT lang, count(*) AS n, avg(len(w)) AS avgdl, max(len(w)) AS longest FROM worded GROUP BY lang),
    df AS (SELECT lang, term, count(*) AS df FROM tf GROUP BY ALL)"""
QUERIES = """asked AS (SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS query FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r
        FROM conversations WHERE role = 'user') WHERE r <= 2 GROUP BY conv_id),
    corpus_of AS (SELECT conv_id, ['en', 'de', 'fr', 'es'][conv_id % 4 + 1] AS lang FROM (SELECT DISTINCT conv_id FROM conversations))"""
FOUND = f"""terms AS (SELECT DISTINCT conv_id, lang, unnest(w) AS term FROM (SELECT conv_id, lang, {sql_retrieval_words('query')} AS w FROM asked JOIN corpus_of USING (conv_id))),
    scores AS (SELECT conv_id, tf.lang, doc_id, passage, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / avgdl))) AS score
        FROM terms JOIN tf USING (lang, term) JOIN df USING (lang, term) JOIN stats USING (lang) JOIN worded USING (lang, doc_id, passage) GROUP BY ALL),
    found AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY round(score, 9) DESC, doc_id, passage) AS rank FROM scores) WHERE rank <= 4)"""


def passage_table(t):
    return retrieval.passages(t.documents, ["lang", "doc_id"], "source")


def corpus_of(t):
    langs = F.array(*[F.lit(x) for x in ("en", "de", "fr", "es")])
    return t.conversations.select("conv_id").distinct().withColumn("lang", F.get(langs, (F.col("conv_id") % 4).cast("int")))


def found(t):
    indexed = retrieval.write_index(passage_table(t), "lang", ["doc_id", "passage"])
    asked = retrieval.user_query(t.conversations).join(corpus_of(t), "conv_id")
    return retrieval.search(asked, indexed, "conv_id")


@query("retrieval_words", f"SELECT doc_id, md5(array_to_string({sql_retrieval_words('text')}, ' ')) AS words_md5, len({sql_retrieval_words('text')}) AS n FROM documents")
def retrieval_words(t):
    w = spread(t.documents).select("doc_id", text.retrieval_words(F.col("text")).alias("w"))
    return w.select("doc_id", F.md5(F.array_join("w", " ")).alias("words_md5"), F.size("w").cast("bigint").alias("n"))


@query("word_counts", f"SELECT doc_id, CAST({sql_count('text')} AS BIGINT) AS n_words FROM documents")
def word_counts(t):
    return t.documents.select("doc_id", text.rough_words(F.col("text")).cast("bigint").alias("n_words"))


@query("sentences", f"SELECT doc_id, len({sql_sentences('text')}) AS n, md5(array_to_string({sql_sentences('text')}, '|')) AS sentences_md5 FROM documents")
def sentences(t):
    s = t.documents.select("doc_id", text.sentences(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").cast("bigint").alias("n"), F.md5(F.array_join("s", "|")).alias("sentences_md5"))


@query("paragraphs", rf"""SELECT doc_id, len(list_filter(list_transform(string_split(regexp_replace(text, '\n\s*\n', chr(2), 'g'), chr(2)), lambda s: {sql_strip('s')}), lambda s: s <> '')) AS n FROM documents""")
def paragraphs(t):
    return t.documents.select("doc_id", F.size(text.paragraphs(F.col("text"))).cast("bigint").alias("n"))


@query("passages", f"WITH {PASSAGES} SELECT doc_id, CAST(passage AS BIGINT) AS passage, n_words, md5(text) AS text_md5 FROM passages")
def passages(t):
    return passage_table(t).select("doc_id", F.col("passage").cast("bigint").alias("passage"), F.col("n_words").cast("bigint").alias("n_words"), F.md5("text").alias("text_md5"))


@query("corpus_statistics", f"""WITH {PASSAGES}, {INDEXED} SELECT lang, n AS passages, round(avgdl, 6) AS avg_length, longest AS max_length,
    (SELECT count(*) FROM df WHERE df.lang = stats.lang) AS terms, (SELECT CAST(sum(df) AS BIGINT) FROM df WHERE df.lang = stats.lang) AS postings FROM stats""")
def corpus_statistics(t):
    return retrieval.corpus_summary(passage_table(t), "lang").select(
        "lang", "passages", F.round("avg_length", 6).alias("avg_length"), F.col("max_length").cast("bigint").alias("max_length"), "terms", "postings")


@query("user_queries", f"WITH {QUERIES} SELECT conv_id, query FROM asked")
def user_queries(t):
    return retrieval.user_query(t.conversations)


@query("best_passages", f"WITH {PASSAGES}, {INDEXED}, {QUERIES}, {FOUND} SELECT conv_id, rank, lang, doc_id, CAST(passage AS BIGINT) AS passage, round(score, 5) AS score FROM found")
def best_passages(t):
    return found(t).select("conv_id", F.col("rank").cast("bigint").alias("rank"), "lang", "doc_id", F.col("passage").cast("bigint").alias("passage"), F.round("score", 5).alias("score"))


SQL_KNOWLEDGE = fixed.KNOWLEDGE_PROMPT.replace("'", "''")


@query("grounded_prompts", f"""WITH {PASSAGES}, {INDEXED}, {QUERIES}, {FOUND},
    body AS (SELECT conv_id, string_agg('[' || rank || '] ' || p.text, chr(10) || chr(10) ORDER BY rank) AS body, count(*) AS n FROM found f JOIN passages p USING (doc_id, passage) GROUP BY conv_id),
    own AS (SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) FILTER (role = 'system') AS own, count(*) FILTER (role <> 'system') AS rest FROM conversations GROUP BY conv_id)
    SELECT conv_id, md5(coalesce(own || chr(10) || chr(10), '') || '{SQL_KNOWLEDGE}' || chr(10) || chr(10) || 'Knowledge:' || chr(10) || coalesce(body, '(nothing relevant found)')) AS system_md5,
        md5('Knowledge:' || chr(10) || coalesce(body, '(nothing relevant found)')) AS knowledge_md5, rest + 1 AS messages, coalesce(n, 0) AS passages
    FROM own LEFT JOIN body USING (conv_id)""")
def grounded_prompts(t):
    done = retrieval.ground(retrieval.message_arrays(t.conversations), found(t))
    return done.select("conv_id", F.md5(F.col("messages")[0]["content"]).alias("system_md5"),
                       F.md5(F.concat(F.lit(fixed.KNOWLEDGE_MARK), prompts.knowledge_of(F.col("messages")))).alias("knowledge_md5"),
                       F.size("messages").cast("bigint").alias("messages"), F.size("passages").cast("bigint").alias("passages"))


@query("summary_prompts", f"""SELECT conv_id, md5('{fixed.SUMMARY_PROMPT}' || CASE WHEN conv_id % 3 = 0 THEN ' Focus on: next steps.' ELSE '' END || chr(10) || chr(10)
    || string_agg(role || ': ' || text, chr(10) ORDER BY turn)) AS prompt_md5 FROM conversations GROUP BY conv_id""")
def summary_prompts(t):
    parts = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    threads = t.conversations.groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda s: F.concat(s["role"], F.lit(": "), s["text"])), "\n").alias("thread"))
    focus = F.when(F.col("conv_id") % 3 == 0, F.lit("next steps"))
    return threads.select("conv_id", F.md5(prompts.summary_messages(F.col("thread"), focus)[0]["content"]).alias("prompt_md5"))
