"""The registered queries beside plain versions over a small whole table, and what the operators promise about ids, letters, long words."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from plumbline.llm import bpe, fingerprints, language, queries, scoring, toxicity

FOLDER = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def table():
    return pd.read_parquet(f"{FOLDER}/documents.parquet").sort_values("doc_id").reset_index(drop=True)


@pytest.fixture(scope="module")
def run(spark):
    return lambda name: queries.QUERIES[name](spark, FOLDER).toPandas()


def lowered(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def held(ids, folds, fold):
    return [zlib.crc32(str(i).encode()) % folds == fold for i in ids]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    reader = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    reader.no_truncation()
    reader.no_padding()
    return reader


def test_op1(run, table):
    got = run("op1_lm_scoring").set_index("doc_id")
    tokens = {i: [*WORDS.findall(lowered(t)), "\n"] for i, t in zip(table.doc_id, table.text)}
    out = dict(zip(table.doc_id, held(table.doc_id, 10, 0)))
    count = Counter(w for i, ts in tokens.items() if not out[i] for w in ts)
    total, distinct = sum(count.values()), len(count)
    assert len(got) == len(table) and (got.train_tokens == total).all()
    for i, ts in tokens.items():
        assert (got.held_out[i], got.n_tokens[i], got.n_known[i]) == (out[i], len(ts), sum(w in count for w in ts))
        assert np.isclose(got.base_score[i], sum(np.log10((count[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in ts))
    assert np.isfinite(got.score).all() and (got.score < 0).all()


def test_op2(run, table, tokenizer):
    got = run("op2_bpe").set_index("doc_id")
    for i, t in zip(table.doc_id, table.text):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        want = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest())
        assert tuple(got.loc[i, ["n_tokens", "ids_sha256", "decoded_sha256"]]) == want


def test_op4(run, table):
    """Likeness is 2 A.B / (A.A + B.B) of the five-word shingle counts."""
    def shingles(t):
        out = Counter()
        for p in filter(None, t.split("\n")):
            w = p.split()
            out.update([tuple(w[k:k + 5]) for k in range(len(w) - 4)] if len(w) >= 5 else [p])
        return out

    def likeness(a, b):
        a, b = shingles(a), shingles(b)
        whole = sum(v * v for v in a.values()) + sum(v * v for v in b.values())
        return 2 * sum(v * b[k] for k, v in a.items()) / whole if whole else 1.0
    got, texts = run("op4_fingerprints").set_index("doc_id"), [t or "" for t in table.text]
    off = []
    for i, t, following in zip(table.doc_id, texts, texts[1:] + texts[:1]):
        half = len(t) // 2
        edited = t[:len(t) - half] + following[:half]
        assert (got.n_chars[i], got.edited_sha256[i]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        off += [abs(got.near_edited[i] - likeness(t, edited)), abs(got.near_next[i] - likeness(t, following))]
    assert np.mean(off) <= 0.03 and max(off) <= 0.15
    by = {}
    for t, f in zip(texts, got.fingerprint[table.doc_id]):
        assert by.setdefault(t, f) == f


def test_op5(run, table, tokenizer):
    got = run("op5_packing")
    want = Counter()
    for i, t in zip(table.doc_id, table.text):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        first = (len(ids) - 1) % 2048 + 1
        for n, (a, b) in enumerate([(0, first), *((a, a + 2048) for a in range(first, len(ids), 2048))]):
            want[i, n, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter(zip(got.doc_id, got.piece, got.start, got.length, got.ids_crc32)) == want
    placed = got.sort_values(["sequence_id", "offset"])
    by = placed.groupby("sequence_id").length
    assert (placed.offset == by.cumsum() - placed.length).all() and by.sum().max() <= 2048
    assert got.sequence_id.nunique() <= 1.02 * (-(-got.length.sum() // 2048)) + 1


def test_op6(run, table):
    got = run("op6_sharding").set_index("doc_id")
    raw = [(t or "").encode() for t in table.text]
    assert got["size"][table.doc_id].tolist() == [len(b) + 16 for b in raw] and got.text_crc32[table.doc_id].tolist() == [zlib.crc32(b) for b in raw]
    assert (got.law == "bytes").all() and got.grown_shard.isna().all() and set(got.shard) <= set(range(40))
    assert all(sorted(s.slot) == list(range(len(s))) for _, s in got.groupby("shard"))


def test_op7(run, table):
    got = run("op7_toxicity").set_index("doc_id")
    assert got.held_out[table.doc_id].tolist() == held(table.doc_id, 4, 2)
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.3)).all()


def test_op8(run, table):
    got = run("op8_licences").set_index("doc_id")
    phrases = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
    for i, t in zip(table.doc_id, table.text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t))
        at = [(k, label) for p, label in phrases.items() for k in range(len(words)) if words[k:k + len(p.split())] == p.split()]
        row = got.loc[i]
        assert (row.n_words, row.n_base, row.base_labels) == (len(words), len(at), ",".join(sorted({label for _, label in at})))
        assert not at or (row.first_word, row.last_word) == (min(at)[0], max(at)[0])
        assert set(filter(None, row.base_labels.split(","))) <= set(row.labels.split(",")) and 0 <= row.score <= 1


def test_op9(run, table):
    import xxhash

    def fingerprint(t):
        w = WORDS.findall(lowered(t))
        hashes = [xxhash.xxh64_intdigest(" ".join(w[k:k + 3]).encode(), seed=42) for k in range(max(1, len(w) - 2))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    got, fps = run("op9_simhash").set_index("doc_id"), [fingerprint(t) for t in table.text]
    assert got.fingerprint[table.doc_id].tolist() == [f"{f:016x}" for f in fps]
    label = list(range(len(fps)))
    while (new := [min(label[j] for j in range(len(fps)) if (fps[i] ^ fps[j]).bit_count() <= 3) for i in range(len(fps))]) != label:
        label = new
    assert got.component_id[table.doc_id].tolist() == [table.doc_id[g] for g in label]


def test_op10(run, table):
    got = run("op10_language").set_index("doc_id")
    out = held(table.doc_id, 3, 1)
    assert got.held_out[table.doc_id].tolist() == out
    told = [(got.lang_pred[i], lang) for i, lang, h in zip(table.doc_id, table.lang, out) if h and lang is not None]
    assert np.mean([a == b for a, b in told]) > 0.95 and got.score.between(0, 1).all()


# ---- ids, letters, long words ------------------------------------------------------------------------------------------

@pytest.mark.parametrize("kind", ["smallint", "string", "decimal(9,0)"])
def test_ids_of_other_types(spark, kind):
    data = [(i, f"text number {i} and more words {i % 3}") for i in range(1, 41)]
    docs = spark.createDataFrame(data, "doc_id int, text string").withColumn("doc_id", F.col("doc_id").cast(kind))
    assert scoring.score(docs).count() == 40 and dict(scoring.score(docs).dtypes)["doc_id"] == kind
    order = sorted(data, key=lambda r: str(r[0])) if kind != "smallint" else data
    want = {str(i): hashlib.sha256(fingerprints.edited(t, order[(k + 1) % 40][1]).encode()).hexdigest() for k, (i, t) in enumerate(order)}
    got = fingerprints.with_next(docs.repartition(5)).collect()
    assert {str(g["doc_id"]): g["edited_sha256"] for g in got} == want


def test_letters_of_all_planes():
    assert (language.lowered("\U00030000 \U000313AF1")[[1, 3]] == [0x30000, 0x313AF]).all() and language.scored("\U00031000", ["x"], [np.zeros((language.BUCKETS, 1), np.float32)])[0] == "x"


def test_long_words_lose_no_piece():
    r = random.Random(2)
    for n in (1, 5, 63, 64, 65, 66, 67, 130, 500):
        word = bytes(r.choices(b"abcdefgh", k=n))
        marked = b" " + word + b" "
        want = {marked[i:i + toxicity.PIECE] for i in range(max(1, len(marked) - toxicity.PIECE + 1))}
        found = [toxicity.pieces(w) for w in toxicity.windows(b"x " + word)[1:]]
        assert {p for f in found for p in f} == want and all(len(w) <= toxicity.WINDOW_BYTES + 2 for w in toxicity.windows(word))


def test_counts_of_long_texts_do_not_wrap():
    h = fingerprints.Hasher()
    a, b = h.of("same words again and again\n" * 70_000), h.of("same words again and again\n" * 35_000)
    assert abs(a.likeness(b) - 2 * 2 / (4 + 1)) < 0.01


def test_words_merge_as_in_the_library(tokenizer):
    codec, r = bpe.Codec(public_tokenizers.path("byte_bpe_50k.json")), random.Random(3)
    assert codec.merged is not None and all(codec.merged(t) == [i] for i, t in enumerate(codec.token[:50_256]))  # every token's bytes come about one way
    letters = "eeetttaoinsrhldcumfpgwybvkxjqz" * 3 + "éèüößçñÀÉ" + "日本語中文한국어доброе"
    for _ in range(20_000):
        word = " " * r.randint(0, 1) + "".join(r.choices(letters, k=r.randint(1, 25)))
        assert codec.merged(word.encode()) == tokenizer.encode(word, add_special_tokens=False).ids


def test_equal_strings_are_found(monkeypatch):
    r, distinct = random.Random(4), bpe.Distinct()
    for broken in (False, True):  # also with a first hash that tells nothing apart
        if broken:
            distinct.values[0] = np.zeros(256, np.uint64)
        parts = [bytes(r.choices(b"ab\x00\xff", k=r.randint(0, 6))) for _ in range(3000)]
        data, ends = np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(p) for p in parts])
        first, which = distinct.of(data, ends - [len(p) for p in parts], ends)
        assert [parts[first[w]] for w in which] == parts and len(first) == len(set(parts))
