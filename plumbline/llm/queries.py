"""The queries of this folder, each an operator over its whole table, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import bpe, conversations, exact, fingerprints, language, licences, mixing, packing, scoring, sharding, simhash, spelling, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def table(spark: SparkSession, folder: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def sql_crc32(numbers: str) -> str:
    """Unsigned CRC-32 of a list of bytes: each byte is added in and followed by eight shifts, which stand in the list as -1."""
    steps = f"flatten(list_transform({numbers}, lambda b: [b, -1, -1, -1, -1, -1, -1, -1, -1]))"
    turn = "lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END"
    return f"xor(list_reduce(list_prepend(4294967295, CAST({steps} AS BIGINT[])), {turn}), 4294967295)"


@query("op2_bpe")
def op2_bpe(spark: SparkSession, folder: str) -> DataFrame:
    tokens = bpe.decode(bpe.encode(table(spark, folder), BYTE_BPE), BYTE_BPE)
    return tokens.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                         F.sha2("text", 256).alias("decoded_sha256"))


@query("op5_packing")
def op5_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder), BYTE_BPE)


@query("op6_sharding")
def op6_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard(table(spark, folder)).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op3_exact_dedup", r"""
    WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
    SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
    FROM d WINDOW w AS (PARTITION BY text_sha256)""")
def op3_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact.copies(table(spark, folder))


@query("op7_toxicity")
def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder)
    return toxicity.classify(docs, toxicity.train(docs, table(spark, folder, "labels")))


@query("op9_simhash")
def op9_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.group(table(spark, folder)).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op10_language")
def op10_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder)
    return language.predict(docs, language.train(docs))


@query("op1_lm_scoring")
def op1_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return scoring.score(table(spark, folder))


@query("op4_fingerprints")
def op4_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.with_next(table(spark, folder))


@query("op8_licences")
def op8_licences(spark: SparkSession, folder: str) -> DataFrame:
    return licences.digest(licences.scan(table(spark, folder)))


@query("op11_mixing")
def op11_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder))


SQL_CODES = "flatten(list_transform(string_split({0}, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [195, unicode(c) - 64] END))"


@query("op12_spelling", rf"""
    WITH RECURSIVE found AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) AS raw FROM documents),
    lowered AS (SELECT doc_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS times FROM found GROUP BY ALL),
    hashed AS (SELECT run, times, {sql_crc32(SQL_CODES.format("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run"))} AS h FROM lowered),
    spelled AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, times FROM hashed),
    vocabulary AS (SELECT word, CAST(sum(times) AS BIGINT) AS n FROM spelled WHERE length(word) >= 5 GROUP BY word HAVING sum(times) >= 3),
    places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM vocabulary),
    shorter AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM places),
    pairs AS (SELECT a.word, b.word AS near, b.n FROM shorter a JOIN shorter b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
              UNION SELECT a.word, b.word, b.n FROM shorter a JOIN vocabulary b ON a.rest = b.word
              UNION SELECT b.word, a.word, a.n FROM shorter a JOIN vocabulary b ON a.rest = b.word),
    ranked AS (SELECT word, near, n, row_number() OVER (PARTITION BY word ORDER BY n DESC, near) AS r, count(*) OVER (PARTITION BY word) AS n_near FROM pairs),
    forms AS (SELECT v.word, v.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.n >= 2 * v.n THEN r.near END AS form, CASE WHEN r.n >= 2 * v.n THEN r.n END AS form_n
              FROM vocabulary v LEFT JOIN ranked r ON v.word = r.word AND r.r = 1),
    followed AS (SELECT word, word AS here FROM forms UNION ALL SELECT f.word, g.form FROM followed f JOIN forms g ON g.word = f.here WHERE g.form IS NOT NULL),
    roots AS (SELECT f.word, f.here AS root FROM followed f JOIN forms g ON g.word = f.here WHERE g.form IS NULL)
    SELECT word, form, root, n, n_near, form_n FROM forms JOIN roots USING (word)""")
def op12_spelling(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(table(spark, folder))


@query("op13_trie", rf"""
    WITH keyed AS (SELECT conv_id AS c, turn, sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')) AS k,
                          len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words FROM conversations WHERE conv_id IS NOT NULL),
    placed AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, k) - 1 AS place FROM keyed),
    convs AS (SELECT c, c - c % 20 AS b, {sql_crc32("list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: unicode(x))")} % 4 AS h FROM (SELECT DISTINCT c FROM placed)),
    joined AS (SELECT s.c, 0 AS own, p.place, p.k, p.words FROM convs s JOIN placed p ON p.c = s.b WHERE p.place < s.h
               UNION ALL SELECT s.c, 1, p.place, p.k, p.words FROM convs s JOIN placed p ON p.c = s.c WHERE p.place >= s.h),
    rebuilt AS (SELECT c, row_number() OVER w AS depth, array_to_string(list(k) OVER w, ',') AS node, words FROM joined WINDOW w AS (PARTITION BY c ORDER BY own, place)),
    paths AS (SELECT c, depth, node, words, coalesce(lag(node) OVER (PARTITION BY c ORDER BY depth), '') AS up, lead(node) OVER (PARTITION BY c ORDER BY depth) IS NULL AS stops FROM rebuilt
              UNION ALL SELECT c, 0, '', 0, NULL, c NOT IN (SELECT c FROM rebuilt) FROM convs),
    nodes AS (SELECT node, depth, min(c) AS conv_id, count(*) AS n_convs, any_value(words) AS words, any_value(up) AS up,
                     sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE stops), '')) AS ends_sha256 FROM paths GROUP BY node, depth),
    children AS (SELECT up, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY up),
    counted AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM nodes n LEFT JOIN children k ON k.up = n.node),
    below AS (SELECT p.node, sum(CASE WHEN n.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n.n_convs - 1) * n.words) AS saved_tokens
              FROM counted n JOIN paths p ON p.c = n.conv_id AND p.depth <= n.depth GROUP BY p.node)
    SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, n.n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
    FROM counted n JOIN below s USING (node) LEFT JOIN counted u ON n.depth > 0 AND u.node = n.up""")
def op13_trie(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.trie(table(spark, folder, "conversations"))
