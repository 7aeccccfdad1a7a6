"""Model runs with native stand-ins for the model, whose answers depend on the prompts alone, so that SQL can follow every step."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import draws, fixed
from plumbline.operators import model_runs
from plumbline.plans.registry import query, sql_unit
from plumbline.session import fresh_path


def sql_filled(template: str, **parts: str) -> str:
    """A template as SQL: its text and the parts' expressions side by side."""
    pieces, rest = [], template.replace("'", "''")
    while "{" in rest:
        head, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        pieces += [f"'{head}'", f"coalesce({parts[name]}, '')"]
    return " || ".join([*pieces, f"'{rest}'"]).replace("\n", "' || chr(10) || '")


def _failed(prompt):
    """One call in 256 fails."""
    return F.when(F.md5(prompt).startswith("ff"), F.lit("ClientError: busy"))


# ---- judged comparisons -----------------------------------------------------------------------------------------------

def judge(rows):
    """Says yes to nine prompts in sixteen, in several spellings."""
    first = F.substring(F.md5("prompt"), 1, 1)
    said = F.when(first < "4", "Yes.").when(first < "9", " yes, it is").when(first < "c", "No.").otherwise("not quite")
    return rows.withColumn("error", _failed(F.col("prompt"))).withColumn("response", F.when(F.col("error").isNull(), said)).withColumn("finish_reason", F.lit("stop"))


ARMS = f"""questions AS (SELECT doc_id AS id, lang, doc_id % 3 <> 0 AS answerable, 'SYSTEM: Answer from the knowledge.' || chr(10) || chr(10) || 'USER: ' || substr(text, 1, 60) AS conversation, substr(text, 61, 40) AS reference FROM documents),
    replies AS (SELECT doc_id AS id, 'base' AS arm, substr(text, 1, 30) AS reply FROM documents UNION ALL SELECT doc_id, 'tuned', substr(text, 5, 30) FROM documents WHERE doc_id % 10 <> 0),
    prompts AS (SELECT id, arm, {sql_filled(fixed.JUDGE_PROMPT, conversation='conversation', reply='reply', reference='reference', status=f"CASE WHEN answerable THEN '{fixed.JUDGE_ANSWERED}' ELSE '{fixed.JUDGE_NOT_ANSWERED}' END")} AS p1,
        {sql_filled(fixed.INVENTS_PROMPT, conversation='conversation', reply='reply')} AS p2 FROM replies JOIN questions USING (id)),
    verdicts AS (SELECT id, arm, substr(md5(p1), 1, 1) < '9' AS acceptable, substr(md5(p2), 1, 1) < '9' AS invents FROM prompts WHERE NOT starts_with(md5(p1), 'ff') AND NOT starts_with(md5(p2), 'ff')),
    judged AS (SELECT v.*, lang, answerable FROM verdicts v JOIN questions USING (id) WHERE id IN (SELECT id FROM verdicts GROUP BY id HAVING count(*) = 2))"""


def _judged_arms(t):
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    said = F.array(message("system", F.lit("Answer from the knowledge.")), message("user", F.substring("text", 1, 60)))
    questions = t.documents.select(F.col("doc_id").alias("id"), "lang", (F.col("doc_id") % 3 != 0).alias("answerable"), said.alias("messages"), F.substring("text", 61, 40).alias("reference"))
    base = t.documents.select(F.col("doc_id").alias("id"), F.lit("base").alias("arm"), F.substring("text", 1, 30).alias("reply"))
    tuned = t.documents.where("doc_id % 10 <> 0").select(F.col("doc_id").alias("id"), F.lit("tuned").alias("arm"), F.substring("text", 5, 30).alias("reply"))
    return model_runs.knowledge_evaluation(questions, base.unionByName(tuned), judge, fresh_path(t.spark, "judged"))


@query("knowledge_evaluation", f"""WITH {ARMS} SELECT arm, count(*) AS n, round(avg(CAST(acceptable AS DOUBLE)), 3) AS acceptable,
    round(avg(CAST(acceptable AS DOUBLE)) FILTER (answerable), 3) AS answerable, round(avg(CAST(acceptable AS DOUBLE)) FILTER (NOT answerable), 3) AS unanswerable,
    round(avg(CAST(acceptable AS DOUBLE)) FILTER (lang = 'en'), 3) AS english, round(avg(CAST(acceptable AS DOUBLE)) FILTER (lang <> 'en'), 3) AS other_languages,
    round(avg(CAST(invents AS DOUBLE)), 3) AS invents, round(avg(CAST(invents AS DOUBLE)) FILTER (answerable), 3) AS invents_answerable,
    round(avg(CAST(invents AS DOUBLE)) FILTER (NOT answerable), 3) AS invents_unanswerable FROM judged GROUP BY arm""")
def knowledge_evaluation(t):
    return _judged_arms(t)[0]


@query("judged_replies", f"WITH {ARMS} SELECT id, arm, lang, answerable, acceptable, invents FROM judged")
def judged_replies(t):
    return _judged_arms(t)[1]


def chooser(rows):
    first = F.substring(F.md5("prompt"), 1, 1)
    said = F.when(first < "6", "1").when(first < "c", " 2. The second").otherwise("=")
    return rows.withColumn("error", _failed(F.col("prompt"))).withColumn("response", F.when(F.col("error").isNull(), said)).withColumn("finish_reason", F.lit("stop"))


PAIRWISE = f"""prompts AS (SELECT p_partkey, 1 AS ord, {sql_filled(fixed.PAIRWISE_PROMPT, prompt='p_name', a='p_brand', b='p_type')} AS p FROM part
    UNION ALL SELECT p_partkey, 2, {sql_filled(fixed.PAIRWISE_PROMPT, prompt='p_name', a='p_type', b='p_brand')} FROM part),
    said AS (SELECT *, substr(md5(p), 1, 1) AS c FROM prompts WHERE NOT starts_with(md5(p), 'ff')),
    both_said AS (SELECT * FROM said WHERE p_partkey IN (SELECT p_partkey FROM said GROUP BY 1 HAVING count(*) = 2))"""


@query("compared_answers", f"WITH {PAIRWISE} SELECT count(*) AS judgements, round(avg(CASE WHEN c < '6' THEN ord - 1 WHEN c < 'c' THEN 2 - ord ELSE 0.5 END), 3) AS b_win_rate FROM both_said")
def compared_answers(t):
    pairs = t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("prompt"), F.col("p_brand").alias("a"), F.col("p_type").alias("b"))
    return model_runs.compare_answers(pairs, chooser, fresh_path(t.spark, "compared"), batches=3)[0]


# ---- labelling --------------------------------------------------------------------------------------------------------

def labeller(rows):
    """Puts a share on A and the rest on B, from the number of turns it was shown and the last one."""
    last = F.element_at("messages", -1)["content"]
    u = draws.unit("teacher", F.size("messages"), F.md5(last))
    seen = F.map_from_arrays(F.array(F.lit("A"), F.lit("B")), F.array(u, 1 - u))
    return rows.withColumn("error", _failed(last)).withColumn("seen", F.when(F.col("error").isNull(), seen))


def _sql_item(state: str) -> str:
    return f"""'{{"state":' || to_json({state}) || ',"question":"Which one?","options":[' || opts || ']}}'"""


@query("labelled_templates", f"""WITH t AS (SELECT p_partkey, p_name, p_brand, p_type, CASE WHEN p_partkey % 2 = 0 THEN 3 ELSE 10 END AS n FROM part),
    o AS (SELECT *, array_to_string(list_transform(range(n), lambda i: '{{"label":"' || chr(CAST(65 + i AS INTEGER)) || '","key":"k' || i || '","description":"option ' || i || '"}}'), ',') AS opts FROM t),
    halves AS (SELECT p_partkey, n, 0 AS pair_no, 'a' AS side, {_sql_item('p_name')} AS item FROM o UNION ALL SELECT p_partkey, n, 0, 'b', {_sql_item('p_type')} FROM o
        UNION ALL SELECT p_partkey, n, 1, 'a', {_sql_item('p_brand')} FROM o UNION ALL SELECT p_partkey, n, 1, 'b', {_sql_item("p_brand || p_type")} FROM o),
    seen AS (SELECT *, {sql_unit('CASE WHEN n <= 8 THEN 2 + 2 * n ELSE 2 END', 'md5(item)', seed='teacher')} AS u, starts_with(md5(item), 'ff') AS failed FROM halves),
    probs AS (SELECT *, least(u, 1 - u) * 0.5 AS low FROM seen WHERE p_partkey NOT IN (SELECT p_partkey FROM seen WHERE failed))
    SELECT 't' || p_partkey AS tid, CAST(pair_no AS BIGINT) AS pair_no, side, round(u / (1 + (n - 2) * low), 6) AS on_a, round((1 - u) / (1 + (n - 2) * low), 6) AS on_b, round(low / (1 + (n - 2) * low), 6) AS on_last FROM probs""")
def labelled_templates(t):
    """Parts as templates, half of them with more options than are shown as examples."""
    many = F.when(F.col("p_partkey") % 2 == 0, 3).otherwise(10)
    key = lambda i: F.concat(F.lit("k"), i.cast("string"))
    options = F.transform(F.sequence(F.lit(0), many - 1), lambda i: F.struct(key(i).alias("key"), F.concat(F.lit("option "), i.cast("string")).alias("description")))
    examples = F.transform(F.sequence(F.lit(0), many - 1), lambda i: F.struct(F.concat("p_brand", key(i)).alias("state"), key(i).alias("gold")))
    empty = F.lit(None).cast("map<string,double>")
    pair = lambda a, b: F.struct(a.alias("a"), b.alias("b"), empty.alias("teacher_a"), empty.alias("teacher_b"))
    pairs = F.array(pair(F.col("p_name"), F.col("p_type")), pair(F.col("p_brand"), F.concat("p_brand", "p_type")))
    templates = t.part.select(F.concat(F.lit("t"), F.col("p_partkey").cast("string")).alias("tid"), F.lit("Which one?").alias("question"), options.alias("options"), examples.alias("examples"), pairs.alias("pairs"))
    done = model_runs.label(templates, labeller, fresh_path(t.spark, "labels"), batches=2)
    rows = done.select("tid", F.size("options").alias("n"), F.posexplode("pairs").alias("at", "p")).select(
        "tid", "n", F.col("at").cast("bigint").alias("pair_no"), F.explode(F.create_map(F.lit("a"), F.col("p.teacher_a"), F.lit("b"), F.col("p.teacher_b"))).alias("side", "m"))
    last = F.element_at("m", F.concat(F.lit("k"), (F.col("n") - 1).cast("string")))
    return rows.select("tid", "pair_no", "side", F.round(F.element_at("m", "k0"), 6).alias("on_a"), F.round(F.element_at("m", "k1"), 6).alias("on_b"), F.round(last, 6).alias("on_last"))


# ---- distillation and summaries ---------------------------------------------------------------------------------------

def writer(rows, name: str, busy: bool):
    """Answers with a part of its last prompt. A busy one fails on half of the prompts; some answers are blank or cut off."""
    last = F.element_at("messages", -1)["content"]
    first = F.substring(F.md5(last), 1, 1)
    said = F.when(first == "0", F.lit("  \n")).otherwise(F.concat(F.lit(f" {name}: "), F.substring(last, -20, 20), F.lit("\n")))
    error = F.when((first < "8") & F.lit(busy), F.lit("ClientError: busy"))
    return rows.withColumn("error", error).withColumn("response", F.when(error.isNull(), said)).withColumn("finish_reason", F.when(first == "f", "length").otherwise("stop"))


SQL_SPACES = r"[\s\x{00A0}\x{0085}\x{2028}\x{2029}]+"


@query("distilled_answers", rf"""WITH p AS (SELECT conv_id || '-' || turn AS id, text, substr(md5(text), 1, 1) AS c FROM conversations WHERE role = 'user')
    SELECT id, regexp_replace(CASE WHEN c < '8' THEN 'second: ' ELSE 'first: ' END || right(text, 20), '{SQL_SPACES}$', '') AS response, c = 'f' AS truncated FROM p WHERE c <> '0'""")
def distilled_answers(t):
    """Two runs over one journal: the first one's client fails on half of the prompts, and the second asks for those only."""
    message = F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("content")))
    rows = t.conversations.where("role = 'user'").select(F.concat_ws("-", "conv_id", "turn").alias("id"), message.alias("messages"))
    path = fresh_path(t.spark, "distilled")
    model_runs.distil(rows, "id", lambda todo: writer(todo, "first", True), path, batches=2)
    return model_runs.distil(rows, "id", lambda todo: writer(todo, "second", False), path).select("id", "response", "truncated")


@query("written_summaries", rf"""WITH p AS (SELECT doc_id, lang, {sql_filled(fixed.SUMMARY_PROMPT)} || CASE WHEN doc_id % 3 = 0 THEN ' Focus on: ' || source || '.' ELSE '' END || chr(10) || chr(10) || text AS prompt FROM documents),
    s AS (SELECT *, substr(md5(prompt), 1, 1) AS c FROM p)
    SELECT doc_id, lang, md5(prompt) AS prompt_md5, regexp_replace('notes: ' || right(prompt, 20), '{SQL_SPACES}$', '') AS response, c = 'f' AS truncated FROM s WHERE c <> '0'""")
def written_summaries(t):
    threads = t.documents.select("doc_id", "text", F.when(F.col("doc_id") % 3 == 0, F.col("source")).alias("focus"), "lang")
    done = model_runs.summaries(threads, "doc_id", lambda todo: writer(todo, "notes", False), fresh_path(t.spark, "summaries"))
    return done.select("doc_id", "lang", F.md5(F.get("messages", 0)["content"]).alias("prompt_md5"), "response", "truncated")


# ---- teacher chats ----------------------------------------------------------------------------------------------------

def teacher(rows):
    """Declines three questions in sixteen; else answers with the question's start and the number of turns it was shown."""
    asked = F.element_at("messages", -1)["content"]
    first = F.substring(F.md5(asked), 1, 1)
    said = F.when(first < "3", "I don't have that information.").when(first == "e", " ").otherwise(
        F.concat(F.lit("Re: "), F.substring(asked, 1, 20), F.lit(" #"), F.size("messages").cast("string")))
    return rows.withColumn("error", _failed(asked)).withColumn("response", F.when(F.col("error").isNull(), said)).withColumn("finish_reason", F.when(first == "d", "length").otherwise("stop"))


def says_unknown(rows):
    return rows.withColumn("verdict", F.when(F.col("response").startswith("I don't"), "Yes").otherwise("no"))


@query("teacher_chats", rf"""WITH q AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS j, turn % 4 = 0 AS answerable, substr(md5(text), 1, 1) AS c, starts_with(md5(text), 'ff') AS failed
        FROM conversations WHERE role = 'user'),
    k AS (SELECT *, NOT failed AND c <> 'e' AND (answerable OR c < '3') AS kept FROM q),
    h AS (SELECT *, coalesce(bool_or(kept) OVER (PARTITION BY conv_id ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AND {sql_unit('conv_id', 'j', seed='0', salt='carry')} < 0.3 AS carried FROM k)
    SELECT conv_id, j AS turn, CASE WHEN conv_id % 2 = 0 THEN 'English' ELSE 'German' END AS lang, CAST(CASE WHEN carried THEN 4 ELSE 2 END AS BIGINT) AS n_messages, answerable, c = 'd' AS truncated,
        CASE WHEN c < '3' THEN 'I don''t have that information.' ELSE regexp_replace('Re: ' || substr(text, 1, 20) || ' #' || CASE WHEN carried THEN 4 ELSE 2 END, '{SQL_SPACES}$', '') END AS response FROM h WHERE kept""")
def teacher_chats(t):
    """Every conversation as a knowledge base whose questions are its user turns; every other turn can't be answered from it."""
    asked = F.struct("turn", F.col("text").alias("question"), (F.col("turn") % 4 == 0).alias("answerable"))
    chats = t.conversations.where("role = 'user'").groupBy("conv_id").agg(F.array_sort(F.collect_list(asked)).alias("q"))
    questions = F.transform("q", lambda x: F.struct(x["question"].alias("question"), x["answerable"].alias("answerable")))
    jobs = chats.select(F.col("conv_id").alias("id"), F.when(F.col("conv_id") % 2 == 0, "English").otherwise("German").alias("lang"),
                        F.when(F.col("conv_id") % 3 == 0, "You are the customer chat assistant.").alias("system"), F.array(F.get("q", 0)["question"]).alias("passages"), questions.alias("questions"))
    done = model_runs.teacher_chat(jobs, teacher, fresh_path(t.spark, "teacher"), says_unknown)
    return done.select(F.col("id").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "lang", F.size("messages").cast("bigint").alias("n_messages"), "answerable", "truncated", "response")


# ---- grounded questions -----------------------------------------------------------------------------------------------

def pupil(rows):
    """Translates by shouting. States the answer of its note to three in four questions, declines where it is told to in most cases."""
    last = F.element_at("messages", -1)["content"]
    first = F.substring(F.md5(F.substring_index(last, "\n\n", 1)), 1, 1)
    told = F.regexp_extract(last, 'the answer is "([^"]*)"', 1)
    reply = F.when(first < "c", F.when(told != "", F.concat(F.lit("It is "), F.upper(told), F.lit("."))).otherwise(F.lit("I don't have that information."))).otherwise("Around 7 or so.")
    said = F.when(last.startswith("Translate this question"), F.upper(F.substring_index(last, "\n\n", -1))).otherwise(reply)
    return rows.withColumn("error", F.lit(None).cast("string")).withColumn("response", said).withColumn("finish_reason", F.lit("stop"))


@query("grounded_questions", """WITH r AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN upper('What is ' || doc_id || ' about?') ELSE 'What is ' || doc_id || ' about?' END AS question,
        CASE WHEN doc_id % 2 = 0 THEN 'part ' || doc_id END AS span, CASE WHEN doc_id % 5 = 0 THEN 'German' ELSE 'English' END AS lang FROM documents),
    s AS (SELECT *, CASE WHEN substr(md5(question), 1, 1) >= 'c' THEN 'Around 7 or so.' WHEN span IS NULL THEN 'I don''t have that information.' ELSE 'It is ' || upper(span) || '.' END AS response FROM r)
    SELECT doc_id, lang, span IS NOT NULL AS answerable, response, CAST(4 AS BIGINT) AS passages, true AS own_passage FROM s
    WHERE CASE WHEN span IS NULL THEN response LIKE 'I don%' WHEN lang = 'German' THEN contains(response, CAST(doc_id AS VARCHAR)) ELSE contains(lower(response), lower(span)) END""")
def grounded_questions(t):
    """A question about every document, half of them with an answer and every fifth in another language."""
    start = F.concat(F.col("doc_id").cast("string"), F.lit(": "), F.regexp_replace(F.substring(F.coalesce("text", F.lit("")), 1, 200), r"\s+", " "))
    asked = F.concat(F.lit("What is "), F.col("doc_id").cast("string"), F.lit(" about?"))
    rows = t.documents.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("doc"), start.alias("context"), asked.alias("question"),
                              F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("part "), F.col("doc_id").cast("string"))).alias("span"), F.when(F.col("doc_id") % 5 == 0, "German").alias("lang"))
    contexts = t.documents.select(F.col("doc_id").alias("doc"), start.alias("text"))
    done = model_runs.grounded_questions(rows, contexts, pupil, fresh_path(t.spark, "grounded"), says_unknown)
    known = F.get("messages", 0)["content"]
    own = known.contains(F.concat(F.lit("] "), F.col("id").cast("string"), F.lit(": ")))
    return done.select(F.col("id").alias("doc_id"), "lang", "answerable", "response", F.regexp_count(known, F.lit(r"\n\n\[[1-9]\] |Knowledge:\n\[1\] ")).cast("bigint").alias("passages"), own.alias("own_passage"))
