"""Decision requests, prompts, tournaments and answers over conversations, documents, parts and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import dates, fixed, maths, prompts
from plumbline.operators import metrics, requests, scoring
from plumbline.plans.metric_queries import PREDS, predictions
from plumbline.plans.registry import query, sql_key, sql_unit
from plumbline.plans.retrieval_queries import sql_retrieval_words

TRIAGE = {
    "team": ("choice", "Which team should handle this?", [("billing", "Payments, refunds, invoices"), ("shipping", "Delivery delays, damaged or lost parcels"),
                                                          ("technical", "App or website problems"), ("sales", "Pre-purchase questions")]),
    "wants_refund": ("noul", "Does the customer ask for their money back?", None),
    "urgency": ("score", "How urgent is this?", ["Can wait a week", "Within two days", "Today", "Immediately"]),
    "angry": ("noul", "Is the customer frustrated or angry?", None),
}


def _question_json() -> str:
    import json
    out = {}
    for qid, (kind, ask, criteria) in TRIAGE.items():
        out[qid] = {"type": kind, "instructions": ask}
        if criteria:
            out[qid]["criteria"] = dict(criteria) if kind == "choice" else criteria
    return json.dumps(out)


def bodies(t):
    """A triage request about every user turn; the texts of the tables have few of the option words, so two are added."""
    extra = F.get(F.array(*[F.lit(x) for x in (" The parcel was lost, refunds please.", " The website has problems today.", "", " Invoices and payments!")]), (F.col("conv_id") % 4).cast("int"))
    return t.conversations.filter("role = 'user'").select(F.concat_ws("-", "conv_id", "turn").alias("request_id"), F.concat(
        F.lit('{"state":'), prompts.json_string(F.concat("text", extra)), F.lit(',"questions":' + _question_json() + "}")).alias("body"))


def _sql_decisions() -> str:
    rows = []
    for o, (qid, (kind, _, criteria)) in enumerate(TRIAGE.items()):
        options = criteria or [("true", fixed.YES_DEFAULT), ("false", fixed.NO_DEFAULT)]
        options = options if kind != "score" else [(str(i), d) for i, d in enumerate(options)]
        rows += [f"({o}, '{qid}', '{kind}', {i}, '{k}', '{k.replace('_', ' ')} {d}')" for i, (k, d) in enumerate(options)]
    return f"""states AS (SELECT conv_id || '-' || turn AS request_id, text || [' The parcel was lost, refunds please.', ' The website has problems today.', '', ' Invoices and payments!'][conv_id % 4 + 1] AS state
        FROM conversations WHERE role = 'user'),
    seen AS (SELECT request_id, {sql_retrieval_words('state')} AS w FROM states),
    options(ord, qid, kind, pos, key, said) AS (VALUES {', '.join(rows)}),
    said AS (SELECT *, {sql_retrieval_words('said')} AS o FROM options),
    shared AS (SELECT request_id, ord, qid, kind, pos, key, len(list_distinct(list_intersect(w, o))) AS n FROM seen, said),
    probs AS (SELECT *, exp(n) / sum(exp(n)) OVER (PARTITION BY request_id, qid) AS p, count(*) OVER (PARTITION BY request_id, qid) AS k FROM shared),
    answers AS (SELECT request_id, ord, qid, kind, round(max(p) FILTER (kind = 'noul' AND key = 'true'), 4) AS noul,
        CASE WHEN kind = 'choice' THEN arg_max(key, round(p, 12) - pos * 1e-11) END AS choice, CASE WHEN kind = 'score' THEN round(sum(pos * p), 4) END AS score,
        CASE WHEN kind <> 'noul' THEN round(greatest(0, 1 + sum(p * ln(p)) / ln(any_value(k))), 4) END AS confidence FROM probs GROUP BY request_id, ord, qid, kind)"""


@query("triage_decisions", f"WITH {_sql_decisions()} SELECT request_id, CAST(ord AS BIGINT) AS ord, qid, kind, noul, choice, score, confidence FROM answers")
def triage_decisions(t):
    done, _ = scoring.decide(bodies(t), prompts=False)
    return done.select("request_id", F.col("ord").cast("bigint").alias("ord"), "qid", "kind", "noul", "choice", "score", "confidence")


@query("decision_prompts", f"""WITH {_sql_decisions()}, o AS (SELECT ord, qid, kind, string_agg('{{"label":"' || chr(CAST(65 + pos AS INTEGER)) || '","key":"' || key || '","description":"' || replace(substr(said, length(key) + 2), '"', '\\"') || '"}}', ',' ORDER BY pos) AS opts FROM options GROUP BY ALL)
    SELECT request_id, qid, md5('{{"question":"' || CASE qid {' '.join(f"WHEN '{q}' THEN '{ask}'" for q, (_, ask, _) in TRIAGE.items())} END || '","options":[' || opts || '],"state":' || to_json(state) || '}}') AS prompt_md5 FROM states, o""")
def decision_prompts(t):
    tasks = requests.with_prompts(requests.accepted(requests.explode_tasks(bodies(t))))
    return tasks.select("request_id", "qid", F.md5(F.col("messages")[1]["content"]).alias("prompt_md5"))


@query("request_errors", """SELECT event_id, CASE k WHEN 0 THEN 'body' WHEN 1 THEN 'state' WHEN 2 THEN 'questions' WHEN 3 THEN 'questions.q' WHEN 4 THEN 'questions.q.instructions' WHEN 5 THEN 'questions.q.type'
        WHEN 6 THEN 'questions.q.criteria' WHEN 7 THEN 'questions.q.criteria' WHEN 8 THEN 'questions.q.criteria' WHEN 9 THEN 'questions.q.criteria.b' END AS field FROM (SELECT event_id, event_id % 11 AS k FROM events) WHERE k < 10""")
def request_errors(t):
    """Every event carries its JSON properties as the state of a request; ten of eleven requests have one mistake."""
    shapes = ['[1]', '{"questions":{"q":{"type":"noul","instructions":"Is it?"}}}', '{"state":%s,"questions":{}}', '{"state":%s,"questions":{"q":"why"}}',
              '{"state":%s,"questions":{"q":{"type":"noul"}}}', '{"state":%s,"questions":{"q":{"type":"rank","instructions":"Is it?"}}}',
              '{"state":%s,"questions":{"q":{"type":"noul","instructions":"Is it?","criteria":{"true":"y"}}}}',
              '{"state":%s,"questions":{"q":{"type":"choice","instructions":"Which?","criteria":{"a":"one"}}}}',
              '{"state":%s,"questions":{"q":{"type":"score","instructions":"How much?","criteria":["low"]}}}',
              '{"state":%s,"questions":{"q":{"type":"choice","instructions":"Which?","criteria":{"a":"one","b":7}}}}',
              '{"state":%s,"questions":{"q":{"type":"noul","instructions":"Is it?"}}}']
    body = F.replace(F.get(F.array(*[F.lit(s) for s in shapes]), (F.col("event_id") % 11).cast("int")), F.lit("%s"), F.col("props"))
    rows = t.events.select("event_id", body.alias("body"))
    return requests.rejected(requests.explode_tasks(rows, "event_id"), "event_id").select("event_id", "field")


@query("state_prompts", """SELECT event_id, md5('{"question":"Is it?","options":[{"label":"A","key":"true","description":"' || 'Yes: the statement in the question holds for this input.' || '"},{"label":"B","key":"false","description":"'
    || 'No: the statement in the question does not hold for this input.' || '"}],"state":' || replace(props, ' ', '') || '}') AS prompt_md5 FROM events""")
def state_prompts(t):
    """Structured states stay JSON in the prompt, with their key order."""
    rows = t.events.select("event_id", F.concat(F.lit('{"state":'), "props", F.lit(',"questions":{"q":{"type":"noul","instructions":"Is it?"}}}')).alias("body"))
    tasks = requests.with_prompts(requests.accepted(requests.explode_tasks(rows, "event_id"), "event_id"))
    return tasks.select("event_id", F.md5(F.col("messages")[1]["content"]).alias("prompt_md5"))


@query("tournament", f"""WITH {PREDS}, o AS (SELECT vec_id, i, (i - 1) // 8 AS g, logits[i] AS x FROM raw, range(1, 11) r(i)),
    p AS (SELECT *, exp(x - max(x) OVER w) / sum(exp(x)) OVER w * exp(max(x) OVER w) AS p FROM o WINDOW w AS (PARTITION BY vec_id, g)),
    winners AS (SELECT vec_id, g, max(p) AS wp, max(x) AS x FROM p GROUP BY vec_id, g),
    final AS (SELECT vec_id, g, wp, exp(x) / sum(exp(x)) OVER (PARTITION BY vec_id) AS f FROM winners),
    spread AS (SELECT vec_id, i, f * p / wp AS q FROM p JOIN final USING (vec_id, g))
    SELECT vec_id, i - 1 AS pos, round(q / sum(q) OVER (PARTITION BY vec_id), 6) AS prob FROM spread""")
def tournament(t):
    options = predictions(t).withColumn("options", F.transform("logits", lambda x, i: F.struct(i.alias("key"), x.alias("x"))))
    done = scoring.tournament(options, "options", lambda group: maths.softmax(F.transform(group, lambda o: o["x"])))
    return done.select("vec_id", F.posexplode("probs").alias("pos", "prob")).select("vec_id", F.col("pos").cast("bigint").alias("pos"), F.round("prob", 6).alias("prob"))


@query("typed_answers", f"""WITH {PREDS} SELECT vec_id, CASE vec_id % 3 WHEN 0 THEN 'choice' WHEN 1 THEN 'score' ELSE 'noul' END AS kind,
    CASE WHEN vec_id % 3 = 0 THEN 'k' || (list_position(probs, top) - 1) END AS choice, CASE WHEN vec_id % 3 = 1 THEN round(list_sum(list_transform(probs, lambda p, i: p * (i - 1))), 4) END AS score,
    CASE WHEN vec_id % 3 = 2 THEN round(probs[1], 4) END AS noul FROM scored""")
def typed_answers(t):
    kind = F.when(F.col("vec_id") % 3 == 0, "choice").when(F.col("vec_id") % 3 == 1, "score").otherwise("noul")
    rows = predictions(t).withColumn("kind", kind).withColumn("probs", maths.softmax(F.col("logits"))).withColumn("options", F.transform(
        "logits", lambda x, i: F.struct(F.when((F.col("kind") == "noul") & (i == 0), "true").otherwise(F.concat(F.lit("k"), i.cast("string"))).alias("key"), F.lit("d").alias("description"))))
    return requests.answers(rows).select("vec_id", "kind", "choice", "score", "noul")


@query("chat_prompts", """SELECT p_partkey, md5('{"state":"' || p_name || '","question":"Which brand?","options":[{"label":"A","key":"a","description":"first"},{"label":"B","key":"b","description":"second"}]}') AS last_md5,
    CAST(2 + 2 * (p_partkey % 3) AS BIGINT) AS messages, CASE WHEN p_partkey % 3 > 0 THEN 'B' END AS first_answer FROM part""")
def chat_prompts(t):
    option = lambda k, d: F.struct(F.lit(k).alias("key"), F.lit(d).alias("description"))
    options = F.array(option("a", "first"), option("b", "second"))
    shot = F.struct(prompts.json_string(F.col("p_brand")).alias("state_json"), F.lit("b").alias("gold"))
    shots = F.slice(F.array(shot, shot), F.lit(1), (F.col("p_partkey") % 3).cast("int"))
    rows = t.part.select("p_partkey", prompts.turn_messages(prompts.json_string(F.col("p_name")), F.lit("Which brand?"), options, shots).alias("m"))
    return rows.select("p_partkey", F.md5(F.element_at("m", -1)["content"]).alias("last_md5"), F.size("m").cast("bigint").alias("messages"),
                       F.when(F.size("m") > 2, F.get("m", 2)["content"]).alias("first_answer"))


@query("training_samples", f"""WITH r AS (SELECT CAST(doc_id AS VARCHAR) AS id, lang || ' ' || source || ' ' || n_chars AS state, source, lang FROM documents),
    o AS (SELECT id, k, row_number() OVER (PARTITION BY id ORDER BY {sql_key('id', 'k')}) AS pos FROM r, (VALUES ('one'), ('two'), ('three')) v(k)),
    l AS (SELECT id, string_agg('{{"label":"' || chr(CAST(64 + pos AS INTEGER)) || '","key":"' || k || '","description":"about ' || k || '"}}', ',' ORDER BY pos) AS opts,
        max(chr(CAST(64 + pos AS INTEGER))) FILTER (k = 'three') AS answer, max(chr(CAST(64 + pos AS INTEGER))) FILTER (k = 'two') AS shown FROM o GROUP BY id)
    SELECT id, answer, {sql_unit('id', salt='explain')} < {fixed.EXPLAIN_SHARE} AS explained, CASE WHEN {sql_unit('id', salt='explain')} < {fixed.EXPLAIN_SHARE} THEN length('It says ' || lang) + 1 ELSE 0 END AS tail_chars,
        md5('{{"question":"Which one?","options":[' || opts || ']' || CASE WHEN {sql_unit('id', salt='zero')} >= {fixed.ZERO_SHOT_SHARE} THEN ',"examples":[{{"state":' || to_json(source) || ',"answer":"' || shown || '"}}]' ELSE '' END
            || ',"state":' || to_json(state) || '}}') AS prompt_md5 FROM r JOIN l USING (id)""")
def training_samples(t):
    """A training sample about every document's properties, options and examples in a hashed order."""
    from plumbline.operators import curation
    option = lambda k: F.struct(F.lit(k).alias("key"), F.lit("about " + k).alias("description"))
    rows = t.documents.select(
        F.col("doc_id").cast("string").alias("id"), F.lit("Which one?").alias("question"), F.array(*[option(k) for k in ("one", "two", "three")]).alias("options"),
        F.array(F.struct(F.col("source").alias("state"), F.lit("two").alias("gold"))).alias("examples"), F.concat_ws(" ", "lang", "source", F.col("n_chars").cast("string")).alias("state"), F.lit("three").alias("gold"),
        F.concat(F.lit("It says "), "lang").alias("why"))
    done = curation.training_samples(rows)
    return done.select("id", "answer", "explained", F.length("tail").cast("bigint").alias("tail_chars"), F.md5(F.col("messages")[1]["content"]).alias("prompt_md5"))


TONGUES = [("en", "that this from ation"), ("de", "der die das und ich"), ("fr", "le les des une est"), ("es", "el los las una por")]
SQL_TONGUES = ", ".join(f"({i}, '{k}', '{k} {d}')" for i, (k, d) in enumerate(TONGUES))


@query("language_decisions", f"""WITH runs AS (SELECT doc_id, lang, 'whole' AS run, text AS state FROM documents UNION ALL SELECT doc_id, lang, 'start', substr(text, 1, 300) FROM documents WHERE doc_id % 7 <> 0),
    options AS (SELECT i, k, {sql_retrieval_words('d')} AS o FROM (VALUES {SQL_TONGUES}) v(i, k, d)),
    seen AS (SELECT doc_id, lang, run, list_distinct({sql_retrieval_words("coalesce(state, '')")}) AS w FROM runs WHERE doc_id IN (SELECT doc_id FROM runs WHERE run = 'start')),
    best AS (SELECT doc_id, lang, run, arg_min(k, (-len(list_distinct(list_intersect(w, o))), i)) AS picked FROM seen, options GROUP BY ALL)
    SELECT run, lang, count(*) AS n, round(avg(CAST(picked = lang AS DOUBLE)), 6) AS accuracy FROM best GROUP BY run, lang""")
def language_decisions(t):
    """The language of every document, decided from the whole text and from its start; both runs count the documents that both have."""
    run = lambda name, state: t.documents.select("doc_id", "lang", F.lit(name).alias("run"), F.coalesce(state, F.lit("")).alias("state"))
    start = run("start", F.substring("text", 1, 300)).where("doc_id % 7 <> 0")
    done = scoring.ask(run("whole", F.col("text")).unionByName(start), "state", "Which language is this?", "choice", TONGUES)
    picked = F.get(F.array(*[F.lit(k) for k, _ in TONGUES]), maths.first_top(F.col("probs")) - 1)
    both = done.select("doc_id", "lang", "run", (picked == F.col("lang")).alias("correct"))
    same = both.join(start.select("doc_id"), "doc_id", "left_semi")
    return same.groupBy("run", "lang").agg(F.count(F.lit(1)).alias("n"), F.round(metrics.share(F.col("correct")), 6).alias("accuracy"))


GUARD_POLICY = [("run", "Read-only or easily reversible commands on non-production systems."), ("ask_human", "Commands that change real data or configuration but can be undone."),
                ("block", "Destructive or irreversible commands on production, or anything that exfiltrates secrets.")]
SQL_POLICY = ", ".join("(" + str(i) + f", '{k}', '{k.replace('_', ' ')} {d}')" for i, (k, d) in enumerate(GUARD_POLICY))


@query("command_guard", f"""WITH policy AS (SELECT i, k, {sql_retrieval_words('d')} AS o FROM (VALUES {SQL_POLICY}) v(i, k, d)),
    seen AS (SELECT page_id, {sql_retrieval_words('state')} AS w FROM (SELECT page_id, 'Command: curl ' || url || ' on production' AS state FROM pages)),
    shared AS (SELECT page_id, i, k, exp(len(list_distinct(list_intersect(w, o)))) AS e FROM seen, policy),
    probs AS (SELECT page_id, i, k, e / sum(e) OVER (PARTITION BY page_id) AS p FROM shared)
    SELECT page_id, arg_min(k, (-p, i)) AS choice, round(greatest(0, 1 + sum(p * ln(p)) / ln(3)), 4) AS confidence FROM probs GROUP BY page_id""")
def command_guard(t):
    """Every page address as a proposed command: run, ask a person, or block."""
    rows = t.pages.select("page_id", F.concat(F.lit("Command: curl "), "url", F.lit(" on production")).alias("state"))
    done = requests.answers(scoring.ask(rows, "state", "How should this proposed agent command be handled?", "choice", GUARD_POLICY))
    return done.select("page_id", "choice", "confidence")


@query("sql_functions", f"""WITH seen AS (SELECT conv_id, turn, {sql_retrieval_words('text')} AS w FROM conversations),
    options AS (SELECT 'team' AS q, i, k, {sql_retrieval_words("replace(k, '_', ' ') || ' ' || d")} AS o FROM (VALUES {SQL_TONGUES.replace("'en en", "'en").replace("'de de", "'de").replace("'fr fr", "'fr").replace("'es es", "'es")}) v(i, k, d)
        UNION ALL SELECT 'yes', i, k, {sql_retrieval_words("k || ' ' || d")} FROM (VALUES (0, 'true', 'the die le'), (1, 'false', 'der la')) v(i, k, d)
        UNION ALL SELECT 'rate', i, k, {sql_retrieval_words("k || ' ' || d")} FROM (VALUES (0, '0', 'und une'), (1, '1', 'des das'), (2, '2', 'los que')) v(i, k, d)),
    shared AS (SELECT conv_id, turn, w, q, i, k, exp(len(list_distinct(list_intersect(w, o)))) AS e FROM seen, options),
    probs AS (SELECT *, e / sum(e) OVER (PARTITION BY conv_id, turn, q) AS p, count(*) OVER (PARTITION BY conv_id, turn, q) AS n FROM shared)
    SELECT conv_id, turn, md5(array_to_string(any_value(w), ' ')) AS words_md5, arg_min(k, (-e, i)) FILTER (q = 'team') AS choice,
        round(greatest(0, 1 + sum(p * ln(p)) FILTER (q = 'team') / ln(4)), 4) AS sure, round(sum(p) FILTER (q = 'yes' AND k = 'true'), 4) AS yes,
        round(sum(p * i) FILTER (q = 'rate'), 4) AS level, CASE WHEN conv_id % 2 = 0 THEN '2026-03-04' END AS day FROM probs GROUP BY conv_id, turn""")
def sql_functions(t):
    scoring.register_functions(t.spark)
    t.conversations.createOrReplaceTempView("turns_for_sql")
    options = "array(" + ", ".join(f"named_struct('key', '{k}', 'description', '{d}')" for k, d in TONGUES) + ")"
    return t.spark.sql(f"""SELECT conv_id, turn, md5(array_join(retrieval_words(text), ' ')) AS words_md5, decide(text, {options}) AS choice, confidence(option_probs(text, {options})) AS sure,
        yes_no(text, 'the die le', 'der la') AS yes, rate(text, array('und une', 'des das', 'los que')) AS level,
        CAST(get(date_mentions(CASE WHEN conv_id % 2 = 0 THEN 'paid on March 4, 2026' ELSE '' END), 0).date AS STRING) AS day FROM turns_for_sql""")


@query("date_mentions_of_orders", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS d FROM orders")
def date_mentions_of_orders(t):
    text = F.concat(F.lit("Received "), dates.written(F.col("o_orderdate"), F.lit("mdy")), F.lit(" by mail."))
    return t.orders.select("o_orderkey", F.get(dates.find_dates(text), 0)["date"].cast("string").alias("d"))
