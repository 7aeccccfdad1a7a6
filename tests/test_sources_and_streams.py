import gzip
import json

from pyspark.sql import functions as F

from plumbline.sources import bundle, tables
from plumbline.streaming import jobs


def write(path, name, text):
    path.mkdir(parents=True, exist_ok=True)
    (path / name).write_text(text, encoding="utf-8")


def test_records_round_trip_with_odd_separators_and_missing_paths(spark, tmp_path):
    write(tmp_path, "a.jsonl", json.dumps({"id": "1", "text": "a b"}, ensure_ascii=False) + "\n\n" + json.dumps({"id": "2", "text": "c\rd"}) + "\n")
    rows = tables.read_records(spark, str(tmp_path / "a.jsonl"), "id string, text string").filter("id is not null").collect()
    assert [r["text"] for r in rows] == ["a b", "c\rd"]
    assert tables.read_records(spark, str(tmp_path / "none.jsonl"), "id string").count() == 0


def test_write_splits_and_resume(spark, tmp_path):
    out = str(tmp_path / "out")
    df = spark.createDataFrame([("1", "train"), ("2", "val")], "id string, split string")
    tables.write_records(df, out, "split")
    more = spark.createDataFrame([("2",), ("3",)], "id string")
    fresh = tables.append_new(more, out + "/*", "id string")
    assert [r["id"] for r in fresh.collect()] == ["3"]


def test_validated_sinks_and_counts(spark, tmp_path):
    df = spark.createDataFrame([("a", "f", True, []), ("b", "f", False, ["bad"])], "tid string, family string, accepted boolean, problems array<string>")
    counted, seen = tables.with_counts(df, ok=F.col("accepted"))
    tables.write_validated(counted, str(tmp_path / "ok"), str(tmp_path / "bad"))
    assert spark.read.json(str(tmp_path / "bad")).first()["problems"] == ["bad"]
    assert seen.get == {"rows": 2, "ok": 1}


def test_one_gzip_file_per_language(spark, tmp_path):
    for lang in ("en", "de"):
        with gzip.open(tmp_path / f"{lang}.json.gz", "wt", encoding="utf-8") as f:
            f.write(json.dumps({"id": "1", "text": "t", "label_text": "x"}) + "\n")
    got = tables.read_per_language(spark, str(tmp_path / "*.json.gz"), "id string, text string, label_text string")
    assert sorted(r["lang"] for r in got.collect()) == ["de", "en"]


def test_result_documents(spark, tmp_path):
    from plumbline.schemas import RESULT
    write(tmp_path / "run1", "b.json", json.dumps({"benchmark": {"id": "b", "task": "choice", "dataset": "d"}, "status": "failed"}, indent=1))
    write(tmp_path / "run2", "b.json", json.dumps({"benchmark": {"id": "b", "task": "choice", "dataset": "d"}, "status": "complete", "metrics": {"baseline_adjusted_score": 0.4}}))
    rows = tables.read_results(spark, [str(tmp_path / "run1"), str(tmp_path / "run2")], RESULT).orderBy("run_ord").collect()
    assert [(r["run"], r["status"], r["score"]) for r in rows] == [("run1", "failed", None), ("run2", "complete", 0.4)]


def test_bundle(spark, tmp_path):
    write(tmp_path, "plain.md", "No header here.")
    write(tmp_path / "shop", "returns_and-refunds.md", "---\r\ntype: policy\r\ntags: [a, 'b c']\r\ndescription: >\r\n  folded\r\n  text\r\n---\r\n\r\nBody line.\r\n")
    write(tmp_path / "shop" / "deep", "x.md", "---\ntitle: \"Quoted: title\"\ntags:\n  - one\n  - two\nowner:\n  name: n\n---\nText")
    write(tmp_path, "old.md", "---\nstatus: Deprecated\n---\nOld")
    write(tmp_path, "index.md", "listing")
    write(tmp_path, "note.txt", "no")
    write(tmp_path, "open.md", "---\ntitle: never closed\n")
    write(tmp_path, "empty.md", "---\ntype: x\n---\n")
    got = {r["title"]: r["text"] for r in bundle.load_bundle(spark, str(tmp_path)).collect()}
    assert got == {"plain": "No header here.", "shop / returns and refunds": "folded text\n\nTags: a, b c\n\nBody line.",
                   "shop / deep / Quoted: title": "Tags: one, two\n\nText", "open": "---\ntitle: never closed"}
    assert "old" in {r["title"] for r in bundle.load_bundle(spark, str(tmp_path), include_deprecated=True).collect()}


def stream(spark, folder, batches, schema):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(folder))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))


def test_live_queries_with_a_late_turn(spark, tmp_path):
    schema = "conv_id bigint, turn int, role string, text string"
    batches = [[(1, 1, "user", "a"), (1, 2, "assistant", "x"), (2, 1, "user", "solo")], [(1, 5, "user", "c")], [(1, 3, "user", "b")]]
    live = jobs.live_queries(stream(spark, tmp_path / "turns", batches, schema), ttl_ms=None)
    out = jobs.run_to_table(live, "live").collect()
    last = {}
    for r in out:
        last.setdefault(r["conv_id"], []).append(r["query"])
    assert last[2] == ["solo"] and set(last[1]) >= {"b c"}


def test_new_only_and_windowed_latency(spark, tmp_path):
    schema = "id string, ts timestamp, ms double"
    rows = [[("a", "2026-01-01 00:00:01", 5.0), ("b", "2026-01-01 00:00:10", 7.0)], [("a", "2026-01-01 00:00:20", 5.0)], [("c", "2026-01-01 02:00:00", 1.0)]]
    import datetime
    rows = [[(i, datetime.datetime.fromisoformat(t), m) for i, t, m in b] for b in rows]
    source = stream(spark, tmp_path / "log", rows, schema)
    assert sorted(r["id"] for r in jobs.run_to_table(jobs.new_only(source, "id", "ts"), "new").collect()) == ["a", "b", "c"]
    windows = jobs.run_to_table(jobs.windowed_latency(source, "ts", "ms", []), "lat").collect()
    batch = jobs.windowed_latency(spark.read.schema(schema).json(str(tmp_path / "log")), "ts", "ms", []).collect()
    assert [(r["n"], r["p50_ms"]) for r in windows] == [(r["n"], r["p50_ms"]) for r in batch if r["window_start"].hour == 0] and windows[0]["n"] == 3


def test_checked_replies_equal_the_batch_form(spark):
    from plumbline.operators import strict
    df = spark.createDataFrame([("1", "It costs 250. Call 5550100 now.", "price 250"), ("2", "Hello.", "x"), ("3", "Call 5550100.", "x"), ("4", "", "x")], "reply_id string, draft string, source string")
    one = jobs.checked_replies(df, lambda s: F.when(s.startswith("Hello"), "other").otherwise("fact"), lambda s, e: F.lit(0.9))
    two = strict.strict_check(df, "reply_id", F.when(F.col("sentence").startswith("Hello"), "other").otherwise("fact"), F.lit(0.9))
    key = lambda d: sorted((r["reply_id"], r["reply"], r["action"]) for r in d.collect())
    assert key(one) == key(two)


def test_leakage_gate_replays_without_repeats(spark, tmp_path):
    pool = spark.createDataFrame([("one two three",)], "text string")
    gate = jobs.leakage_gate(pool, str(tmp_path / "clean"), str(tmp_path / "held"))
    batch = spark.createDataFrame([("s", "1", "One two, three!"), ("s", "2", "something else"), ("s", "3", "...")], "eval_set string, item_id string, text string")
    gate(batch, 0)
    gate(batch, 0)
    assert [r["item_id"] for r in spark.read.parquet(str(tmp_path / "held")).collect()] == ["1"]
    assert sorted(r["item_id"] for r in spark.read.parquet(str(tmp_path / "clean")).collect()) == ["2", "3"]
