"""Streaming jobs run over everything that is in the tables; batch SQL has to give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import leakage
from plumbline.plans.decision_queries import _sql_decisions, bodies
from plumbline.plans.leakage_queries import FLAGS
from plumbline.plans.registry import Tables, query
from plumbline.plans.retrieval_queries import sql_sentences
from plumbline.plans.strict_queries import SQL_NOTE, sql_facts
from plumbline.session import fresh_path
from plumbline.streaming import jobs


def stream_of(t, name: str):
    return jobs.read_stream(t.spark, t.folder, name, getattr(t, name).schema)


@query("streamed_latency", """SELECT CAST(time_bucket(INTERVAL 1 DAY, ts) AS VARCHAR) AS window_start, event_type, count(*) AS n, round(avg(value), 6) AS mean_ms,
    round(quantile_disc(value, 0.5), 6) AS p50_ms, round(quantile_disc(value, 0.95), 6) AS p95_ms FROM events
    GROUP BY 1, 2 HAVING any_value(time_bucket(INTERVAL 1 DAY, ts)) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""")
def streamed_latency(t):
    log = stream_of(t, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    done = jobs.run_to_table(jobs.windowed_latency(log, "ts", "value", ["event_type"], "1 day"), "latency")
    return done.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n", *[F.round(c, 6).alias(c) for c in ("mean_ms", "p50_ms", "p95_ms")])


@query("streamed_new_events", "SELECT event_id, user_id FROM events")
def streamed_new_events(t):
    """The log delivered twice: every event once. Only ids of the last hour of event time are remembered."""
    log = stream_of(t, "events").unionByName(stream_of(t, "events")).withColumn("ts", F.col("ts").cast("timestamp"))
    return jobs.run_to_table(jobs.new_only(log, "event_id", "ts", "1 hour").select("event_id", "user_id"), "new")


@query("streamed_decisions", f"""WITH {_sql_decisions()} SELECT request_id, qid, noul, choice, score, confidence, NULL AS field FROM answers WHERE CAST(split_part(request_id, '-', 1) AS INTEGER) % 5 <> 0
    UNION ALL SELECT request_id, NULL, NULL, NULL, NULL, NULL, 'questions.broken.type' FROM states WHERE CAST(split_part(request_id, '-', 1) AS INTEGER) % 5 = 0""")
def streamed_decisions(t):
    """Requests as they arrive; in every fifth conversation one question behind the good ones is broken, which rejects the request."""
    fifth = F.split("request_id", "-")[0].cast("int") % 5 == 0
    asked = bodies(Live(t)).withColumn("body", F.when(fifth, F.concat(F.expr("substring(body, 1, length(body) - 2)"), F.lit(',"broken":{"type":"rank","instructions":"Is it?"}}}'))).otherwise(F.col("body")))
    return jobs.run_to_table(jobs.decisions(asked), "decisions").select("request_id", "qid", "noul", "choice", "score", "confidence", "field")


class Live(Tables):
    """Tables whose attributes are streams."""

    def __init__(self, t: Tables):
        super().__init__(t.spark, t.folder)

    def __getattr__(self, name: str):
        return stream_of(Tables(self.spark, self.folder), name)


@query("streamed_leakage_gate", f"""WITH {FLAGS} SELECT i.eval_set, i.item_id, coalesce(f.flagged, false) AS held FROM items i
    LEFT JOIN flags f ON i.eval_set = f.eval_set AND i.item_id = f.item_id WHERE i.eval_set = 'benchmark'""")
def streamed_leakage_gate(t):
    clean, held, mark = (fresh_path(t.spark, x) for x in ("clean", "held", "gate-checkpoint"))
    items = stream_of(t, "benchmark").select(F.lit("benchmark").alias("eval_set"), F.col("item_id").cast("string").alias("item_id"), "text")
    gate = jobs.leakage_gate(leakage.text_pool((t.documents, "text")), clean, held)
    items.writeStream.foreachBatch(gate).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
    read = lambda path, flag: t.spark.read.schema("eval_set string, item_id string, text string").parquet(path).select(
        "eval_set", "item_id", F.lit(flag).alias("held"))
    return read(clean, False).unionByName(read(held, True))


@query("streamed_replies", rf"""WITH r AS (SELECT conv_id, turn, text AS draft, substr(text, 1, length(text) // 2) AS source FROM conversations WHERE role = 'assistant'),
    k AS (SELECT *, {sql_facts('source')} AS known FROM r),
    p AS (SELECT conv_id, turn, source, known, unnest({sql_sentences('draft')}) AS s, generate_subscripts({sql_sentences('draft')}, 1) AS i FROM k),
    j AS (SELECT *, len(list_filter({sql_facts('s')}, lambda x: NOT list_contains(known, x))) > 0 AS missing FROM p),
    f AS (SELECT *, missing OR length(s) % 3 <> 0 AS fact, NOT (missing OR length(s) % 3 <> 0) OR (NOT missing AND contains(source, s)) AS keep FROM j),
    g AS (SELECT conv_id, turn, bool_and(keep) AS all_kept, bool_or(keep AND fact) AS fact_left, coalesce(string_agg(s, ' ' ORDER BY i) FILTER (keep), '') AS said FROM f GROUP BY ALL)
    SELECT r.conv_id, r.turn, CASE WHEN coalesce(all_kept, true) THEN 'sent' WHEN fact_left THEN 'trimmed' ELSE 'declined' END AS action,
        md5(CASE WHEN coalesce(all_kept, true) THEN draft WHEN fact_left THEN said || ' {SQL_NOTE}' ELSE '{SQL_NOTE}' END) AS reply_md5 FROM r LEFT JOIN g USING (conv_id, turn)""")
def streamed_replies(t):
    """Assistant turns against their first half as evidence; a sentence whose length three divides states no fact."""
    half = F.expr("substring(text, 1, length(text) div 2)")
    rows = stream_of(t, "conversations").filter("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("draft"), half.alias("source"))
    done = jobs.checked_replies(rows, lambda s: F.when(F.length(s) % 3 == 0, "other").otherwise("fact"), lambda s, e: e.contains(s).cast("double"))
    return jobs.run_to_table(done.select("conv_id", "turn", "action", F.md5("reply").alias("reply_md5")), "replies")


@query("streamed_user_queries", """SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS query, any_value(seen) AS seen FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r,
    count(*) OVER (PARTITION BY conv_id) AS seen FROM conversations WHERE role = 'user') WHERE r <= 2 GROUP BY conv_id""")
def streamed_user_queries(t):
    """User turns in three deliveries, late ones among them; the newest row of each conversation."""
    path = fresh_path(t.spark, "turns")
    turns = t.conversations.filter("role = 'user'").select("conv_id", F.col("turn").cast("int").alias("turn"), "role", "text")
    late = F.pmod(F.hash(F.md5(F.concat_ws("-", "conv_id", "turn"))), F.lit(3))
    turns.withColumn("delivery", late).repartition(3, "delivery").drop("delivery").write.parquet(path)
    live = jobs.live_queries(t.spark.readStream.schema(turns.schema).option("maxFilesPerTrigger", 1).parquet(path), ttl_ms=None)
    done = jobs.run_to_table(live, "live")
    return done.groupBy("conv_id").agg(F.max_by("query", "seen").alias("query"), F.max("seen").alias("seen"))
