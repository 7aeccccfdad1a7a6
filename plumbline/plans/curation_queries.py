"""Filters, caps, samples and mixes over the driver's tables as training records."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.functions import draws, fixed, maths, prompts, text
from plumbline.operators import curation, ranking
from plumbline.plans.metric_queries import PREDS, scored
from plumbline.plans.registry import query, sql_key, sql_unit, sql_words
from plumbline.sources import tables

LICENCES = ["CC BY-SA 4.0", "CC BY-NC 4.0", "MIT", "research only", "Unknown", "Apache-2.0", "CC0", ""]
SQL_DENY = fixed.LICENCE_DENY
SQL_ALLOW = fixed.LICENCE_ALLOW
SQL_LICENCES = "['" + "', '".join(LICENCES) + "']"


def licences(t):
    """Every supplier is a source with a licence text."""
    return t.supplier.select(F.concat(F.lit("src"), (F.col("s_suppkey") % 20).cast("string")).alias("source"),
                             F.get(F.array(*[F.lit(x) for x in LICENCES]), (F.col("s_suppkey") % 20 % 8).cast("int")).alias("licence")).distinct()


SQL_SOURCES = f"""lic AS (SELECT DISTINCT 'src' || (s_suppkey % 20) AS source, {SQL_LICENCES}[s_suppkey % 20 % 8 + 1] AS licence FROM supplier),
    manifest AS (SELECT source, licence, CASE WHEN regexp_matches(licence, '{SQL_ALLOW}') AND NOT regexp_matches(licence, '{SQL_DENY}') THEN 'used' ELSE 'skipped' END AS decision FROM lic)"""


@query("source_manifest", f"WITH {SQL_SOURCES} SELECT source, licence, decision, count(*) AS rows FROM manifest GROUP BY ALL")
def source_manifest(t):
    return curation.source_manifest(licences(t))


@query("free_documents", f"WITH {SQL_SOURCES} SELECT doc_id, source FROM documents SEMI JOIN (SELECT * FROM manifest WHERE decision = 'used') m USING (source)")
def free_documents(t):
    free = licences(t).filter(curation.licence_decision(F.col("licence")) == "used")
    return t.documents.select("doc_id", "source").join(free, "source", "left_semi")


@query("confident_labels", f"WITH {PREDS} SELECT vec_id, CAST(list_position(probs, top) AS INTEGER) AS label, round(top, 6) AS prob FROM scored WHERE top >= 0.6")
def confident_labels(t):
    keys = F.transform(F.sequence(F.lit(1), F.lit(10)), lambda i: i.cast("string"))
    top = curation.top_label(F.map_from_arrays(keys, "probs"))
    return scored(t).withColumn("t", top).filter(F.col("t.prob") >= fixed.MIN_CONFIDENCE).select(
        "vec_id", F.col("t.label").cast("int").alias("label"), F.round("t.prob", 6).alias("prob"))


REPLY_SQL = "text || CASE conv_id % 4 WHEN 0 THEN ' I don''t know that.' WHEN 1 THEN ' It is not listed here.' WHEN 2 THEN ' Let me put you in touch.' ELSE ' It costs 20.' END"


def _replies(t):
    ends = [" I don't know that.", " It is not listed here.", " Let me put you in touch.", " It costs 20."]
    return t.conversations.filter(F.col("role") == "assistant").withColumn("reply", F.concat("text", F.get(
        F.array(*[F.lit(x) for x in ends]), (F.col("conv_id") % 4).cast("int"))))


@query("refusals", f"SELECT conv_id, turn, regexp_matches({REPLY_SQL}, '{fixed.REFUSAL}') AS refuses FROM conversations WHERE role = 'assistant'")
def refusals(t):
    return _replies(t).select("conv_id", "turn", curation.refuses(F.col("reply")).alias("refuses"))


@query("grounded_replies", f"""WITH q AS (SELECT conv_id, turn, {REPLY_SQL} AS reply, CASE turn % 3 WHEN 0 THEN '' WHEN 1 THEN 'It COSTS 20' ELSE 'costs 20 of 300' END AS span, conv_id % 2 = 0 AS translated FROM conversations WHERE role = 'assistant')
    SELECT conv_id, turn FROM q WHERE CASE WHEN span <> '' THEN CASE WHEN translated THEN len(list_filter(regexp_extract_all(span, '\\p{{Nd}}+'), lambda d: NOT contains(reply, d))) = 0 ELSE contains(lower(reply), lower(span)) END
        ELSE regexp_matches(reply, '{fixed.REFUSAL}') END""".replace("\\\\p", "\\p"))
def grounded_replies(t):
    span = F.when(F.col("turn") % 3 == 0, "").when(F.col("turn") % 3 == 1, "It COSTS 20").otherwise("costs 20 of 300")
    keep = curation.grounded_reply_kept(F.col("reply"), F.col("span"), F.col("conv_id") % 2 == 0)
    return _replies(t).withColumn("span", span).filter(keep).select("conv_id", "turn")


@query("numbers_kept", r"""WITH p AS (SELECT page_id, html AS src, lead(html) OVER (ORDER BY page_id) AS dst FROM pages)
    SELECT page_id, len(regexp_extract_all(src, '\p{Nd}+')) AS numbers, len(list_filter(regexp_extract_all(src, '\p{Nd}+'), lambda d: NOT list_contains(regexp_extract_all(dst, '\p{Nd}+'), d))) = 0 AS kept
    FROM p WHERE dst IS NOT NULL""")
def numbers_kept(t):
    later = t.pages.select((F.col("page_id") - 1).alias("page_id"), F.col("html").alias("dst"))
    return t.pages.join(later, "page_id").select("page_id", F.size(text.digit_runs(F.col("html"))).cast("bigint").alias("numbers"),
                                                 text.keeps_numbers(F.col("html"), F.col("dst")).alias("kept"))


@query("kept_kinds", "SELECT event_id, event_type FROM events WHERE event_type IN ('view', 'click')")
def kept_kinds(t):
    return t.events.filter(F.col("event_type").isin("view", "click")).select("event_id", "event_type")


@query("complete_outputs", "SELECT l_returnflag, count(*) FILTER (l_linestatus = 'O') AS complete, count(*) FILTER (l_linestatus IS DISTINCT FROM 'O') AS cut FROM lineitem GROUP BY 1")
def complete_outputs(t):
    done = curation.complete(F.when(F.col("l_linestatus") == "O", F.lit("stop")).otherwise(F.lit("length")))
    return t.lineitem.groupBy("l_returnflag").agg(F.count_if(done).alias("complete"), F.count_if(~done).alias("cut"))


@query("length_guard", r"SELECT doc_id FROM documents WHERE len(regexp_extract_all(text, '[^\s]+')) <= 300")
def length_guard(t):
    return t.documents.filter(text.rough_words(F.col("text")) <= 300).select("doc_id")


@query("kept_reasons", f"WITH {PREDS} SELECT vec_id, CASE WHEN correct THEN 'because ' || family ELSE '' END AS why FROM scored")
def kept_reasons(t):
    return scored(t).select("vec_id", curation.kept_reason(maths.first_top(F.col("probs")), F.col("gold_pos"), F.concat(F.lit("because "), "family")).alias("why"))


@query("unused_rows", "SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id)")
def unused_rows(t):
    return curation.remaining(t.documents.select("doc_id"), t.labels, key="doc_id")


@query("rows_left_to_do", "SELECT o_orderkey FROM orders ANTI JOIN (SELECT l_orderkey AS o_orderkey FROM lineitem WHERE l_linenumber = 1 UNION SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') d USING (o_orderkey)")
def rows_left_to_do(t):
    done = t.lineitem.filter("l_linenumber = 1").select(F.col("l_orderkey").alias("o_orderkey"))
    rejected = t.lineitem.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return curation.remaining(t.orders.select("o_orderkey"), done, rejected, key="o_orderkey")


@query("without_test_inputs", "SELECT doc_id FROM documents WHERE md5(text) NOT IN (SELECT md5(text) FROM conversations)")
def without_test_inputs(t):
    banned = t.conversations.select(F.md5("text").alias("input_hash")).distinct()
    return t.documents.withColumn("input_hash", F.md5("text")).join(banned, "input_hash", "left_anti").select("doc_id")


@query("family_cap", f"SELECT c_custkey, c_mktsegment FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY {sql_key('c_custkey', seed='3')}) AS r FROM customer) WHERE r <= 150")
def family_cap(t):
    return curation.cap_families(t.customer, "c_custkey", 150, family="c_mktsegment").select("c_custkey", "c_mktsegment")


MIX = f"""fresh AS (SELECT * FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')),
    capped AS (SELECT c_custkey AS id, c_mktsegment AS family, 'public' AS origin FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY {sql_key('c_custkey', seed='3')}) AS r FROM fresh) WHERE r <= 100),
    own AS (SELECT p_partkey AS id, p_type AS family, 'own' AS origin, row_number() OVER (ORDER BY {sql_unit('p_partkey', seed='3')}) AS r, count(*) OVER () AS n FROM part)"""


@query("training_mix", f"WITH {MIX} SELECT * FROM capped UNION ALL SELECT id, family, origin FROM own WHERE r <= round(0.3 * n)")
def training_mix(t):
    public = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("family"), F.lit("public").alias("origin"))
    own = t.part.select(F.col("p_partkey").alias("id"), F.col("p_type").alias("family"), F.lit("own").alias("origin"))
    used = t.orders.filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("id"))
    return curation.mix(public, own, "id", cap=100, used=used, ordered=False)


@query("replay_sample", f"SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY {sql_unit('o_orderkey', seed='4')}) AS r, count(*) OVER () AS n FROM orders) WHERE r <= round(0.3 * n)")
def replay_sample(t):
    return ranking.sample_fraction(t.orders, ["o_orderkey"], 0.3, 4).select("o_orderkey")


@query("fixed_sample", f"SELECT o_orderkey FROM orders ORDER BY {sql_key('o_orderkey', seed='5')} LIMIT 500")
def fixed_sample(t):
    return ranking.sample_rows(t.orders.select("o_orderkey"), ["o_orderkey"], 500, 5)


@query("seeded_shuffle", f"SELECT n_nationkey, row_number() OVER (ORDER BY {sql_key('n_nationkey', seed='3')}) AS place FROM nation")
def seeded_shuffle(t):
    keyed = t.nation.select("n_nationkey", (F.lit(0) - F.conv(F.substring(draws.rank_key(3, F.col("n_nationkey")), 1, 13), 16, 10).cast("double")).alias("k"))
    return ranking.standings(keyed, "k", "place").select("n_nationkey", "place")


@query("half_and_half", f"SELECT doc_id, flag FROM (SELECT *, row_number() OVER (PARTITION BY flag ORDER BY {sql_key('doc_id')}) AS r FROM (SELECT doc_id, n_chars % 2 = 0 AS flag FROM documents)) WHERE r <= 100")
def half_and_half(t):
    flag = F.col("n_chars") % 2 == 0
    rows = t.documents.select("doc_id", "n_chars", flag.alias("flag"))
    return curation.half_and_half(rows, "doc_id", F.col("flag"), 200).select("doc_id", "flag")


@query("whole_pairs", "SELECT vec_id, pair_id FROM (SELECT vec_id, vec_id // 2 AS pair_id, dense_rank() OVER (ORDER BY vec_id // 2) AS r FROM embeddings) WHERE r <= (151 + 1) // 2")
def whole_pairs(t):
    """At most 151 rows, in whole pairs: the first 76 pair ids, found without ranking the rows."""
    rows = t.embeddings.select("vec_id", F.floor(F.col("vec_id") / 2).alias("pair_id"))
    pairs = rows.select("pair_id").distinct().orderBy("pair_id").limit((151 + 1) // 2)
    return rows.join(pairs, "pair_id", "left_semi").select("vec_id", "pair_id")


@query("same_ids_everywhere", f"""WITH s AS (SELECT conv_id FROM (SELECT DISTINCT conv_id FROM conversations WHERE role = 'user') ORDER BY {sql_key('conv_id', seed='0')} LIMIT 40)
    SELECT role, count(*) AS turns, count(DISTINCT conv_id) AS ids FROM conversations JOIN s USING (conv_id) GROUP BY role""")
def same_ids_everywhere(t):
    ids = ranking.sample_rows(t.conversations.filter("role = 'user'").select("conv_id").distinct(), ["conv_id"], 40, 0)
    return t.conversations.join(ids, "conv_id").groupBy("role").agg(F.count(F.lit(1)).alias("turns"), F.count_distinct("conv_id").alias("ids"))


@query("sample_per_source", f"SELECT doc_id, source, r AS rank FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {sql_key('doc_id')}) AS r FROM documents) WHERE r <= 15")
def sample_per_source(t):
    return tables.sample_per_source(t.documents, "source", "doc_id", 5).select("doc_id", "source", F.col("rank").cast("bigint").alias("rank"))


@query("carried_turns", f"""WITH x AS (SELECT conv_id, turn, role, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations)
    SELECT conv_id, turn, CASE WHEN {sql_unit('conv_id', 'turn', seed='1', salt='carry')} < 0.3 THEN md5(prev) END AS carried FROM x WHERE role = 'user'""")
def carried_turns(t):
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    keep = draws.unit(1, F.col("conv_id"), F.col("turn"), salt="carry") < 0.3
    return t.conversations.withColumn("prev", before).filter("role = 'user'").select("conv_id", "turn", F.when(keep, F.md5("prev")).alias("carried"))


@query("option_letters", "SELECT vec_id, i - 1 AS pos, chr(CAST(64 + i AS INTEGER)) AS letter FROM embeddings, range(1, 11) r(i)")
def option_letters(t):
    options = F.transform(F.sequence(F.lit(1), F.lit(10)), lambda i: F.struct(i.cast("string").alias("key"), F.lit("").alias("description")))
    return t.embeddings.select("vec_id", F.posexplode(F.transform(prompts.lettered(options), lambda o: o["label"])).alias("p", "letter")).select(
        "vec_id", F.col("p").cast("bigint").alias("pos"), "letter")


@query("micro_batches", f"""WITH p AS (SELECT doc_id, n_chars, {sql_key('doc_id')} AS draw, CAST((row_number() OVER (ORDER BY {sql_key('doc_id')}, doc_id) - 1) // 128 AS INTEGER) AS pool FROM documents),
    b AS (SELECT doc_id, pool, CAST((row_number() OVER (PARTITION BY pool ORDER BY n_chars, draw, doc_id) - 1) // 8 AS INTEGER) AS batch FROM p),
    s AS (SELECT pool, batch, row_number() OVER (ORDER BY {sql_key('pool', 'batch', salt='batch')}, pool, batch) - 1 AS step FROM (SELECT DISTINCT pool, batch FROM b))
    SELECT doc_id, pool, batch, step FROM b JOIN s USING (pool, batch)""")
def micro_batches(t):
    return curation.micro_batches(t.documents.select("doc_id", "n_chars"), "doc_id", "n_chars").select("doc_id", "pool", "batch", "step")


@query("reduced_options", f"""WITH {PREDS}, o AS (SELECT vec_id, i, probs[i] AS p, i = list_position(probs, top) AS gold FROM scored, range(1, 11) r(i)),
    r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY gold DESC, {sql_key('vec_id', 'i')}) AS k FROM o)
    SELECT vec_id, CAST(i AS VARCHAR) AS key, round(p / sum(p) OVER (PARTITION BY vec_id), 6) AS prob FROM r WHERE k <= 8""")
def reduced_options(t):
    keys = F.transform(F.sequence(F.lit(1), F.lit(10)), lambda i: i.cast("string"))
    rows = scored(t).select("vec_id", F.map_from_arrays(keys, "probs").alias("teacher"), F.transform(keys, lambda k: F.struct(
        k.alias("key"), F.lit("").alias("description"))).alias("options"))
    return curation.tournament_options(rows, ["vec_id"]).select("vec_id", F.explode("teacher").alias("key", "prob")).select(
        "vec_id", "key", F.round("prob", 6).alias("prob"))


@query("soft_labels", f"WITH {PREDS} SELECT vec_id, top < 0.999 AS soft FROM scored")
def soft_labels(t):
    return scored(t).select("vec_id", maths.is_soft(F.col("probs")).alias("soft"))


@query("job_plan", "SELECT 'g' || c_custkey AS id, 'g' AS job FROM customer UNION ALL SELECT 'k' || c_custkey, 'k' FROM customer WHERE c_custkey % 3 = 1 UNION ALL SELECT 's' || c_custkey, 's' FROM customer WHERE c_custkey % 3 = 0")
def job_plan(t):
    return curation.chat_jobs(t.customer.select(F.col("c_custkey").alias("i"))).select("id", "job")


@query("held_out_by_position", f"""SELECT c_custkey, row_number() OVER (ORDER BY {sql_key('c_custkey', seed='5')}, c_custkey) - 1 AS position,
    row_number() OVER (ORDER BY {sql_key('c_custkey', seed='5')}, c_custkey) > 900 AS held_out FROM customer""")
def held_out_by_position(t):
    """Customers in a seeded order; those from the 900th on are held out."""
    done = curation.held_out_from(t.customer, [draws.rank_key(5, F.col("c_custkey")), "c_custkey"], 900)
    return done.select("c_custkey", "position", "held_out")


@query("filled_caps", f"""SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {sql_key('doc_id')}, doc_id) AS r FROM documents WHERE n_chars % 7 < 2) WHERE r <= 5""")
def filled_caps(t):
    """Five documents of every source that can be converted, though most of a sample can't."""
    return curation.filled_caps(t.documents.select("doc_id", "source", "n_chars"), "source", "doc_id", 5, lambda rows: rows.where("n_chars % 7 < 2"), spare=1).select("doc_id", "source")


@query("union_of_sources", "SELECT c_custkey AS id, c_mktsegment AS family, CAST(NULL AS INTEGER) AS size FROM customer UNION ALL SELECT p_partkey, p_type, p_size FROM part")
def union_of_sources(t):
    return t.customer.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("family")).unionByName(
        t.part.select(F.col("p_partkey").alias("id"), F.col("p_type").alias("family"), F.col("p_size").alias("size")), allowMissingColumns=True)


@query("option_sets_equal", "SELECT l_orderkey, list_sort(list_distinct(list(l_returnflag))) = ['A', 'N', 'R'] AS covers FROM lineitem GROUP BY 1")
def option_sets_equal(t):
    flags = F.array_sort(F.collect_set("l_returnflag"))
    return t.lineitem.groupBy("l_orderkey").agg((flags == F.array(F.lit("A"), F.lit("N"), F.lit("R"))).alias("covers"))


@query("valid_keys", r"SELECT p_partkey, regexp_matches(replace(p_name, ' ', CASE WHEN p_partkey % 3 = 0 THEN ' ' ELSE '_' END), '^[a-z][a-z0-9_]*$') AS valid FROM part")
def valid_keys(t):
    key = F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).otherwise(F.replace("p_name", F.lit(" "), F.lit("_")))
    return t.part.select("p_partkey", text.valid_key(key).alias("valid"))


@query("stripped_letters", """SELECT conv_id, turn, md5(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS reason FROM conversations""")
def stripped_letters(t):
    shown = F.concat(F.get(F.array(F.lit("A\n"), F.lit(" (B).\n"), F.lit("")), (F.col("turn") % 3).cast("int")), F.col("text"))
    return t.conversations.select("conv_id", "turn", F.md5(text.strip_letter(shown)).alias("reason"))


@query("filled_prompts", "SELECT p_partkey, 'Decide about ' || p_name || ' (' || p_brand || '): use ' || p_size || ' options. ' || p_name AS prompt FROM part")
def filled_prompts(t):
    return t.part.select("p_partkey", text.fill("Decide about {what} ({brand}): use {n} options. {what}", what=F.col("p_name"),
                                                brand=F.col("p_brand"), n=F.col("p_size")).alias("prompt"))


@query("weighted_languages", f"""WITH w AS (SELECT name, sum(weight) OVER (ORDER BY i) AS hi, sum(weight) OVER () AS total FROM (VALUES {", ".join(f"({i}, '{n}', {w})" for i, (n, w) in enumerate(fixed.LANGUAGE_WEIGHTS))}) v(i, name, weight)),
    d AS (SELECT c_custkey, {sql_unit('c_custkey', salt='share')} AS s, {sql_unit('c_custkey', salt='pick')} AS u FROM customer)
    SELECT c_custkey, CASE WHEN s < 0.3 THEN (SELECT name FROM w WHERE u < hi / total ORDER BY hi LIMIT 1) END AS lang FROM d""")
def weighted_languages(t):
    k = F.col("c_custkey")
    return t.customer.select("c_custkey", curation.language_draw(draws.unit(0, k, salt="share"), draws.unit(0, k, salt="pick"), 0.3).alias("lang"))


@query("weighted_nations", f"""WITH w AS (SELECT n_nationkey, n_name, sum(n_regionkey + 1) OVER (ORDER BY n_name, n_nationkey) AS hi, sum(n_regionkey + 1) OVER () AS total FROM nation),
    d AS (SELECT s_suppkey, {sql_unit('s_suppkey', salt='nation')} AS u FROM supplier)
    SELECT s_suppkey, (SELECT n_name FROM w WHERE u * total < hi ORDER BY hi LIMIT 1) AS n_name FROM d""")
def weighted_nations(t):
    dim = t.nation.select("n_name", (F.col("n_regionkey") + 1).cast("double").alias("weight"))
    return curation.weighted_join(t.supplier.select("s_suppkey"), dim, "weight", draws.unit(0, F.col("s_suppkey"), salt="nation")).select("s_suppkey", "n_name")


@query("pair_counters", """WITH p AS (SELECT l_orderkey, (l_linenumber + 1) // 2 AS pair, count(*) AS halves, count(*) FILTER (l_quantity >= 10) AS kept, min(l_returnflag) FILTER (l_quantity >= 10) AS lo,
        max(l_returnflag) FILTER (l_quantity >= 10) AS hi FROM lineitem GROUP BY 1, 2)
    SELECT count(*) FILTER (kept > 0) AS templates, CAST(sum(halves) AS BIGINT) AS items_in, CAST(sum(kept) AS BIGINT) AS items_kept, CAST(sum(halves - kept) AS BIGINT) AS low_confidence, count(*) FILTER (kept = 2 AND lo <> hi) AS contrastive_pairs_kept FROM p""")
def pair_counters(t):
    """Line items 2k - 1 and 2k are the halves of a pair, the return flag is the label, a small quantity means low confidence."""
    kept = F.col("l_quantity") >= 10
    p = t.lineitem.groupBy("l_orderkey", F.floor((F.col("l_linenumber") + 1) / 2).alias("pair")).agg(
        F.count(F.lit(1)).alias("halves"), F.count_if(kept).alias("kept"), F.min(F.when(kept, F.col("l_returnflag"))).alias("lo"), F.max(F.when(kept, F.col("l_returnflag"))).alias("hi"))
    return p.agg(F.count_if(F.col("kept") > 0).alias("templates"), F.sum("halves").alias("items_in"), F.sum("kept").alias("items_kept"),
                 F.sum(F.col("halves") - F.col("kept")).alias("low_confidence"), F.count_if((F.col("kept") == 2) & (F.col("lo") != F.col("hi"))).alias("contrastive_pairs_kept"))


@query("public_records", f"""WITH {SQL_SOURCES}, {PREDS},
    rows AS (SELECT vec_id, 'src' || (vec_id % 20) AS source, probs, top FROM scored WHERE md5(CAST(vec_id AS VARCHAR)) NOT IN (SELECT md5(CAST(doc_id AS VARCHAR)) FROM labels WHERE toxic = 1)),
    free AS (SELECT r.*, row_number() OVER (PARTITION BY source ORDER BY {sql_key('vec_id')}) AS k FROM rows r WHERE source IN (SELECT source FROM manifest WHERE decision = 'used'))
    SELECT source || '-' || vec_id AS tid, CAST(list_position(probs, top) AS VARCHAR) AS gold FROM free WHERE k <= 12""")
def public_records(t):
    keys = F.transform(F.sequence(F.lit(1), F.lit(10)), lambda i: i.cast("string"))
    rows = scored(t).select(F.col("vec_id").alias("case_id"), F.concat(F.lit("src"), (F.col("vec_id") % 20).cast("string")).alias("source"),
                            F.md5(F.col("vec_id").cast("string")).alias("input_hash"), F.lit("choice").alias("kind"), F.lit("Which one?").alias("question"),
                            F.transform(keys, lambda k: F.struct(k.alias("key"), F.lit("").alias("description"))).alias("options"),
                            F.lit("").alias("state"), F.map_from_arrays(keys, "probs").alias("teacher"))
    banned = t.labels.filter("toxic = 1").select(F.md5(F.col("doc_id").cast("string")).alias("input_hash")).distinct()
    return curation.convert_public(rows, licences(t), banned, 12).select("tid", "gold")


def labelled_orders(t):
    """Orders as labelled templates: conversations' turns are the states, two line items the halves of the pair."""
    turns = t.conversations.filter("role = 'user'").select((F.col("conv_id") * 100 + F.col("turn")).alias("k"), "text")
    ids = turns.withColumn("tid", F.concat(F.lit("t"), F.col("k").cast("string")))
    p = draws.unit(9, F.col("k"), salt="teacher")
    teacher = lambda x: F.create_map(F.lit("yes"), x, F.lit("no"), 1 - x)
    option = lambda k: F.struct(F.lit(k).alias("key"), F.lit("").alias("description"))
    pair = F.struct(F.lit("edit").alias("edit"), F.col("text").alias("a"), F.lit("yes").alias("gold_a"), F.lit("so").alias("why_a"),
                    F.concat("text", F.lit(" not")).alias("b"), F.lit("no").alias("gold_b"), F.lit("so").alias("why_b"), teacher(p).alias("teacher_a"), teacher(p / 2).alias("teacher_b"))
    return ids.select("tid", F.lit("f").alias("family"), F.lit("choice").alias("kind"), F.lit("d").alias("domain"), F.lit("s").alias("style"), F.lit("Is it so?").alias("question"),
                      F.array(option("yes"), option("no")).alias("options"), F.array().cast("array<struct<state:string,gold:string>>").alias("examples"), F.array(pair).alias("pairs"))


@query("built_records", f"""WITH h AS (SELECT 't' || (conv_id * 100 + turn) AS tid, {sql_unit('conv_id * 100 + turn', seed='9', salt='teacher')} AS p FROM conversations WHERE role = 'user'),
    x AS (SELECT tid, 'a' AS half, p, 'yes' AS designed FROM h UNION ALL SELECT tid, 'b', p / 2, 'no' FROM h),
    l AS (SELECT tid, half, designed, CASE WHEN p >= 1 - p THEN 'yes' ELSE 'no' END AS gold, greatest(p, 1 - p) AS conf FROM x)
    SELECT tid || '-0' || half AS id, gold, CASE WHEN gold = designed THEN 'so' ELSE '' END AS why,
        CASE WHEN list_reduce(list_transform(string_split(sha1(tid), ''), lambda c: strpos('0123456789abcdef', c) - 1), lambda a, d: (a * 16 + d) % 100) < 5 THEN 'val' ELSE 'train' END AS split
    FROM l WHERE conf >= 0.6""")
def built_records(t):
    bench = t.benchmark.select("text", F.lit("What is it?").alias("question"))
    return curation.build_records(labelled_orders(t), bench)[0].select("id", "gold", "why", "split")


@query("build_counters", f"""WITH h AS (SELECT 't' || (conv_id * 100 + turn) AS tid, {sql_unit('conv_id * 100 + turn', seed='9', salt='teacher')} AS p FROM conversations WHERE role = 'user'),
    x AS (SELECT tid, 'a' AS half, p, 'yes' AS designed FROM h UNION ALL SELECT tid, 'b', p / 2, 'no' FROM h),
    l AS (SELECT tid, half, designed, CASE WHEN p >= 1 - p THEN 'yes' ELSE 'no' END AS gold, greatest(p, 1 - p) >= 0.6 AS ok,
        list_reduce(list_transform(string_split(sha1(tid), ''), lambda c: strpos('0123456789abcdef', c) - 1), lambda a, d: (a * 16 + d) % 100) < 5 AS val FROM x),
    g AS (SELECT tid, count(*) FILTER (ok) AS kept, count(DISTINCT gold) FILTER (ok) AS golds FROM l GROUP BY tid)
    SELECT (SELECT count(*) FROM g WHERE kept > 0) AS templates, count(*) AS items_in, count(*) FILTER (ok) AS items_kept, count(*) FILTER (NOT ok) AS low_confidence,
        count(*) FILTER (ok AND gold <> designed) AS teacher_overrode_gold, (SELECT count(*) FROM g WHERE kept = 2 AND golds = 2) AS contrastive_pairs_kept, CAST(0 AS BIGINT) AS contaminated,
        count(*) FILTER (ok AND NOT val) AS train_items, count(*) FILTER (ok AND val) AS val_items FROM l""")
def build_counters(t):
    bench = t.benchmark.select("text", F.lit("What is it?").alias("question"))
    return curation.build_records(labelled_orders(t), bench)[1]


@query("distractor_passages", f"""WITH held AS (SELECT doc_id AS other, count(*) OVER () AS n, {sql_unit('doc_id', salt='place')} AS u, {sql_key('doc_id', salt='place')} AS h FROM documents),
    placed AS (SELECT other, row_number() OVER (ORDER BY floor(u * greatest(1, n // 100000)), h, other) - 1 AS place FROM held),
    asked AS (SELECT doc_id, CAST(floor({sql_unit('doc_id', salt='look')} * (SELECT count(*) FROM documents)) AS BIGINT) AS start FROM labels JOIN documents USING (doc_id)),
    met AS (SELECT doc_id, j, other FROM asked, range(4) r(j) JOIN placed ON place = (start + j) % (SELECT count(*) FROM documents) WHERE other <> doc_id)
    SELECT doc_id AS "row", CAST(row_number() OVER (PARTITION BY doc_id ORDER BY j) AS INTEGER) AS rank, other FROM met QUALIFY rank <= 3""")
def distractor_passages(t):
    """Three passages from other documents per labelled document (from a hashed place of the hashed order)."""
    rows = t.labels.join(t.documents.select("doc_id"), "doc_id").select("doc_id", F.col("doc_id").alias("row"))
    return curation.distractors(rows, t.documents.select("doc_id", "text"), "row", "doc_id").select("row", "rank", "other")


@query("mixed_stream", f"""WITH c AS (SELECT conv_id || '-' || turn AS id, greatest(1, count(*) OVER () // 1000) AS b FROM conversations),
    held AS (SELECT id, floor({sql_unit('id', salt='at')} * b) AS shelf FROM c),
    placed AS (SELECT id, shelf, row_number() OVER (PARTITION BY shelf ORDER BY id) - 1 AS nth, count(*) OVER (PARTITION BY shelf) AS n FROM held),
    slots AS (SELECT CAST(doc_id AS VARCHAR) AS slot, {sql_unit('doc_id', salt='chat')} AS u FROM documents),
    wanted AS (SELECT slot, floor({sql_unit('slot', '1', salt='bucket')} * (SELECT max(b) FROM c)) AS shelf, {sql_unit('slot', '1', salt='no')} AS v
        FROM slots WHERE u < CAST(0.25 AS DOUBLE) / (1 - CAST(0.25 AS DOUBLE)))
    SELECT slot, slot AS sample, 'decision' AS stream FROM slots
    UNION ALL SELECT slot, id, 'chat' FROM wanted JOIN placed ON wanted.shelf = placed.shelf AND nth = floor(v * n)""")
def mixed_stream(t):
    """Documents with a share of conversations mixed in by hashed draws with replacement."""
    decisions = t.documents.select(F.col("doc_id").alias("id"))
    chats = t.conversations.select(F.concat_ws("-", "conv_id", "turn").alias("id"))
    return curation.mixed_stream(decisions, chats, 0.25)


def sql_ranges(table: str, column: str, weight: str) -> str:
    return f"(SELECT v, sum(w) OVER (ORDER BY v) AS upto, w, sum(w) OVER () AS total FROM (SELECT {column} AS v, CAST({weight} AS DOUBLE) AS w FROM {table} GROUP BY {column}))"


@query("template_plan", f"""WITH i AS (SELECT CAST(i AS BIGINT) AS i FROM range((SELECT count(*) FROM orders)) r(i)),
    u AS (SELECT i, {', '.join(f"{sql_unit('i', seed='1', salt=s)} AS u_{s}" for s in ('family', 'domain', 'style', 'options', 'pairs'))} FROM i)
    SELECT 's1-' || CASE WHEN i < 1000000 THEN lpad(CAST(i AS VARCHAR), 6, '0') ELSE CAST(i AS VARCHAR) END AS tid, f.v AS family, d.v AS domain, s.v AS style,
        CAST(3 + floor(u_options * 3) AS INTEGER) AS n, CAST(4 + floor(u_pairs * 3) AS INTEGER) AS k,
        CAST(least(4 + floor(u_pairs * 3), (SELECT count(DISTINCT r_name) FROM region)) AS INTEGER) AS n_edits
    FROM u JOIN {sql_ranges('part', 'p_type', 'count(*)')} f ON u_family * f.total < f.upto AND u_family * f.total >= f.upto - f.w
    JOIN {sql_ranges('nation', 'n_name', '1')} d ON u_domain * d.total < d.upto AND u_domain * d.total >= d.upto - d.w
    JOIN {sql_ranges('customer', 'c_mktsegment', '1')} s ON u_style * s.total < s.upto AND u_style * s.total >= s.upto - s.w""")
def template_plan(t):
    """Template specs, one per order, drawn from parts, nations and market segments as dimensions."""
    families = t.part.groupBy(F.col("p_type").alias("family")).agg(F.count(F.lit(1)).cast("double").alias("weight")).select(
        "family", F.lit("choice").alias("kind"), F.lit("what to do").alias("what"), F.lit("3-5 actions").alias("hint"), "weight")
    dim = lambda df, c, name: df.select(F.col(c).alias(name)).distinct().withColumn("weight", F.lit(1.0))
    plan = curation.plan_templates(t.orders.count(), families, dim(t.nation, "n_name", "domain"), dim(t.customer, "c_mktsegment", "style"), dim(t.region, "r_name", "edit"), t.spark)
    return plan.select("tid", "family", "domain", "style", "n", "k", F.size("edits").alias("n_edits"))
