"""The training-data operators beside brute-force versions, on rows with nulls, empty and long texts, ties, repeats and clashing names."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from plumbline.llm import bpe, exact, fingerprints, language, licences, near_copies, packing, scoring, sharding, simhash, toxicity

BPE = public_tokenizers.path("byte_bpe_50k.json")
CLASHING = ["ids", "fp", "_doc", "_id", "size", "shard", "_row", "block", "text_sha256", "lang_pred", "score", "_part", "length", "piece"]
FRENCH = "la maison est dans la rue et le chat dort sur le lit avec les enfants de la ville"
ENGLISH = "the house is in the street and the cat sleeps on the bed with the children of the town"


def rows():
    """(doc_id, text): nulls, empties, white space, copies, near copies, a repeated row, one long text."""
    r = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    long_text = " ".join(r.choices(words, k=30_000))
    base = r.choices(words, k=400)
    near = base[:]
    near[200] = "other"
    return [(1, None), (2, ""), (3, " \n\t "), (4, "Hello  World"), (5, "Hello World"), (6, "hello world"), (7, long_text), (8, " ".join(base)), (9, " ".join(near)), (10, " ".join(base)),
            (10, " ".join(base)), (None, "no id"), (None, None), (11, "under the MIT-License, héé 日本 😀"), (12, "a\x85b\x00c"), (13, ENGLISH), (14, FRENCH), (-5, "Hello World"), (15, "1234 5678 !!")]


@pytest.fixture(scope="module")
def docs(spark):
    made = spark.createDataFrame(rows(), "doc_id long, text string").repartition(3)
    return made.withColumns({c: F.lit(f"{c}!") for c in CLASHING}).withColumn("lang", F.when(F.col("text").startswith("la maison"), "fr").otherwise("en"))


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def text(t):
    return t or ""


# ---- BPE ---------------------------------------------------------------------------------------------------------------

def test_forced_boundaries_never_change_ids():
    codec, r = bpe.Codec(BPE), random.Random(1)
    alphabet = ["a", "b", " ", "  ", "\n", "\t", "'s", "'", "’", "é", "ü", "1", "23", ".", "!!", "日本", "😀", "'re", "'LL", "<|endoftext|>", "ñ ", "\x85", "x y", "ſ", "\x1c", "\x00", "　 ", "the", " lichkeit"]
    for texts in [["".join(r.choices(alphabet, k=r.randint(0, 30))) for _ in range(4000)], ["", ""], []]:
        data = b"".join(t.encode() for t in texts)
        offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
        ids, starts = codec.encode(np.frombuffer(data, np.uint8), offsets)
        want = [e.ids for e in codec.tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert [ids[a:b].tolist() for a, b in zip(starts, starts[1:])] == want
        assert [codec.decode(w) for w in want] == [codec.tokenizer.decode(w, skip_special_tokens=False) for w in want]


def test_encode_and_decode_whole_table(docs, none):
    from tokenizers import Tokenizer

    reader = Tokenizer.from_file(BPE)
    got = bpe.decode(bpe.encode(docs, BPE), BPE).collect()
    assert Counter((r["doc_id"], tuple(r["ids"]), r["text"]) for r in got) == Counter((i, tuple(reader.encode(text(t), add_special_tokens=False).ids), text(t)) for i, t in rows())
    assert bpe.encode(none, BPE).count() == 0


# ---- packing -----------------------------------------------------------------------------------------------------------

def test_plans_use_every_piece_once():
    r = random.Random(2)
    for capacity, n in [(2048, 3000), (16, 500), (7, 1), (1, 5)]:
        counts = Counter(min(capacity, max(1, int(r.lognormvariate(math.log(capacity) - 1, 1)))) for _ in range(n))
        runs, fill, got = packing.plan(dict(counts), capacity), {}, Counter()
        for run in runs:
            for i in range(run.pieces):
                assert run.first + i not in fill.setdefault(("rank", run.length), set())
                fill["rank", run.length].add(run.first + i)
                at = run.offset + i % run.together * run.length
                fill.setdefault(run.sequence + i // run.together, []).append((at, at + run.length))
            got[run.length] += run.pieces
        assert got == counts
        sequences = [sorted(v) for k, v in fill.items() if not isinstance(k, tuple)]
        assert all(s[0][0] == 0 and s[-1][1] <= capacity and all(a[1] == b[0] for a, b in zip(s, s[1:])) for s in sequences)
        bound = max(-(-sum(x * k for x, k in counts.items()) // capacity), sum(k for x, k in counts.items() if 2 * x > capacity))
        assert bound <= len(sequences) <= 1.01 * bound + 1
    assert packing.plan({}) == []


def test_packed_pieces(docs, none):
    codec = bpe.Codec(BPE)
    for capacity in (64, 2048):
        got = packing.pack(docs, BPE, capacity, with_ids=True).toPandas()
        want = []
        for i, t in rows():
            ids = [*codec.tokenizer.encode(text(t), add_special_tokens=False).ids, 0]
            first = (len(ids) - 1) % capacity + 1
            want += [(i, n, a, tuple(ids[a:b]), zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for n, (a, b) in enumerate([(0, first), *((a, a + capacity) for a in range(first, len(ids), capacity))])]
        key = lambda i: None if i is None or pd.isna(i) else int(i)
        assert Counter((key(r.doc_id), r.piece, r.start, tuple(r.ids), r.ids_crc32) for r in got.itertuples()) == Counter(want)
        for _, s in got.groupby("sequence_id"):
            s = s.sort_values("offset")
            assert s.length.sum() <= capacity and (s.offset == s.length.cumsum() - s.length).all()
    assert packing.pack(none, BPE).count() == 0


# ---- sharding ----------------------------------------------------------------------------------------------------------

def test_best_fit_decreasing_beside_a_plain_version():
    r = random.Random(3)
    sizes = [r.randint(1, 60) for _ in range(400)]
    free, want = [], {}
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        fits = [(f, s) for s, f in enumerate(free) if f >= sizes[i]]
        shard = min(fits)[1] if fits else len(free)
        free = free if fits else [*free, 100]
        free[shard] -= sizes[i]
        want[i] = shard
    assert sharding.best_fit_decreasing(sizes, 100) == [want[i] for i in range(len(sizes))]
    assert sharding.best_fit_decreasing([], 5) == []


def test_shards(spark, none):
    data = [(i, f"text {i}" * (1 + i % 30)) for i in range(3000)] + [(i, "same text") for i in range(3000, 4500)] + [(i, f"pair {i // 2}") for i in range(5000, 5400)] + [(None, None), (6000, None)]
    got = sharding.shard(spark.createDataFrame(data, "doc_id long, text string").withColumn("size", F.lit("x")), 8).toPandas()
    assert len(got) == len(data)
    assert all(sorted(s.slot) == list(range(len(s))) for _, s in got.groupby("shard"))
    load = got.groupby("shard")["size"].sum()
    assert len(load) == 8 and load.max() <= 1.02 * load.mean()
    pairs = got[(got.doc_id >= 5000) & (got.doc_id < 5400)]
    assert (pairs.groupby(pairs.doc_id // 2).shard.nunique() == 1).all()
    one = got[got.doc_id == 7].iloc[0]
    assert (one["size"], one.text_crc32) == (len("text 7" * 8) + 16, zlib.crc32(("text 7" * 8).encode()))
    assert sharding.shard(none).count() == 0


def test_groups_that_fit_into_a_shard_stay_whole(spark):
    group = lambda first, n, line, times: [(i, line * times) for i in range(first, first + n)]
    data = [(i, f"text {i}" * (1 + i % 30)) for i in range(3000)] + group(5000, 800, "more than a shard ", 10)
    data += [row for k in range(20) for row in group(10_000 + 10 * k, 2 + k % 3, f"large {k} ", 300)]  # each several parts of a shard, none a whole one
    got = sharding.shard(spark.createDataFrame(data, "doc_id long, text string"), 8).toPandas()
    load = got.groupby("shard")["size"].sum()
    assert len(got) == len(data) and len(load) == 8 and load.max() <= 1.02 * load.mean()
    groups = got.groupby("text_crc32").agg(n=("size", "sum"), shards=("shard", "nunique"))
    assert ((groups.n > load.mean() / 64) & (groups.n <= load.mean())).sum() >= 20
    assert (groups[groups.n <= load.mean()].shards == 1).all() and (groups[groups.n > load.mean()].shards > 1).sum() == 1


# ---- exact duplicates --------------------------------------------------------------------------------------------------

def normalised(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text(t))


def test_copies(spark, docs, none):
    for data, df in [(rows(), docs), (hot := [(i, "hot  text" if i % 3 else f"t{i // 6}") for i in range(3000)], spark.createDataFrame(hot, "doc_id long, text string"))]:
        groups = {}
        for i, t in data:
            groups.setdefault(normalised(t), []).append(i)
        least = {t: min((i for i in g if i is not None), default=None) for t, g in groups.items()}
        got = exact.copies(df).collect()
        want = Counter((i, least[normalised(t)], len(groups[normalised(t)]), hashlib.sha256(normalised(t).encode()).hexdigest()) for i, t in data)
        assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
        assert Counter(r["text_sha256"] for r in got if r["kept"]) == Counter({hashlib.sha256(t.encode()).hexdigest(): 1 for t in groups})
        assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])
        kept = exact.deduplicate(df)
        assert kept.columns == df.columns
        assert Counter(normalised(r["text"]) for r in kept.collect()) == Counter(dict.fromkeys(groups, 1))
    assert exact.copies(none).count() == 0 and exact.deduplicate(none).count() == 0


def test_copies_when_splits_change_between_jobs(spark):
    data = [(i, f"hot {i % 20}" if i < 2000 else f"t{i}") for i in range(3000)]
    random.Random(8).shuffle(data)
    keys = ["spark.sql.files.minPartitionNum", "spark.sql.files.openCostInBytes"]
    try:
        spark.conf.set(keys[1], "1")
        spark.conf.set(keys[0], "1")
        got = exact.copies(spark.createDataFrame(data, "doc_id long, text string").repartition(6))  # the winners are written, the rest isn't planned yet
        spark.conf.set(keys[0], "64")
        kept = [r["doc_id"] for r in got.where("kept").collect()]
    finally:
        for key in keys:
            spark.conf.unset(key)
    assert sorted(kept) == [*range(20), *range(2000, 3000)]


# ---- SimHash -----------------------------------------------------------------------------------------------------------

def brute_fingerprint(t):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text(t)))
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    label = list(range(len(fps)))
    while True:
        new = [min(label[j] for j in range(len(fps)) if (fps[i] ^ fps[j]).bit_count() <= 3) for i in range(len(fps))]
        if new == label:
            return label
        label = new


def test_components(docs, none):
    got = simhash.group(docs).collect()
    fps = [brute_fingerprint(t) for _, t in rows()]
    label = brute_components(fps)
    least = {g: min((i for (i, _), x in zip(rows(), label) if x == g and i is not None), default=None) for g in label}
    assert Counter((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in got) == Counter((i, f, least[g]) for (i, _), f, g in zip(rows(), fps, label))
    assert simhash.group(none).count() == 0


def test_rows_that_stay_are_told_apart_by_text(spark):
    r = random.Random(9)
    other = [" ".join(r.choices([f"v{i}" for i in range(500)], k=60)) for _ in range(8)]  # no two alike
    data = [(None, other[0]), (None, other[1]), (None, other[2]), (1, other[2]), (2, other[3]), (2, other[4]), (3, other[5]), (3, other[5]), (3, f" {other[5]}"), (4, None), (None, other[6]), (None, other[6])]
    kept = near_copies.one_of_each(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert Counter((k["doc_id"], (k["text"] or "").strip()) for k in kept) == Counter([(None, other[0]), (None, other[1]), (1, other[2]), (2, other[3]), (2, other[4]), (3, other[5]), (4, ""), (None, other[6])])


def shingle_sets(texts, size=5):
    words = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text(t))) for t in texts]
    return [{tuple(w[i:i + size]) for i in range(len(w) - size + 1)} or {tuple(w)} for w in words]


def near_pairs(texts, least=0.8):
    """All pairs of texts with that Jaccard similarity, over an index of their shingles."""
    sets, index, common = shingle_sets(texts), {}, Counter()
    for i, s in enumerate(sets):
        for x in s:
            index.setdefault(x, []).append(i)
    for rows_with in index.values():
        common.update((a, b) for k, b in enumerate(rows_with) for a in rows_with[:k])
    return {p for p, c in common.items() if c >= least * (len(sets[p[0]]) + len(sets[p[1]]) - c)}


def first_of_each(ids, pairs):
    """The positions that stay: of each connected group the one of smallest id."""
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for a, b in pairs:
        root[find(a)] = find(b)
    groups = {}
    for i in range(len(ids)):
        groups.setdefault(find(i), []).append(i)
    return sorted(min(g, key=lambda i: (ids[i] is None, ids[i])) for g in groups.values())


def test_near_copies_beside_all_pairs(spark, docs, none):
    r = random.Random(16)
    words = [f"v{i}" for i in range(400)]

    def changed(line, k):
        line = line[:]
        for _ in range(k):
            line[r.randrange(len(line))] = "other"
        return line
    data = []
    for g in range(60):
        base = r.choices(words, k=r.choice([3, 8, 30, 100, 400]))
        data += [" ".join(base)] + [" ".join(changed(base, r.randint(0, max(1, len(base) // 30)))) for _ in range(r.choice([0, 1, 1, 3, 12]))]
    hot = r.choices(words, k=120)
    data += [" ".join(changed(hot, r.randint(0, 2))) for _ in range(400)]  # a large group of near copies
    data += [" ".join(hot[:40] + r.choices(words, k=200)) for _ in range(40)]  # a passage that many share
    data += ["", None, "  ", "one", "One", "two words"]
    order = list(range(len(data)))
    r.shuffle(order)
    data = [(i, data[k]) for i, k in enumerate(order)]
    pairs = near_pairs([t for _, t in data])
    want = [data[i][0] for i in first_of_each([i for i, _ in data], pairs)]
    kept = near_copies.one_of_each(spark.createDataFrame(data, "doc_id long, text string").repartition(6))
    got = {k["doc_id"] for k in kept.collect()}
    assert len(want) < 0.6 * len(data) and set(want) <= got and len(got) <= len(want) + 3  # no link is wrong, and hardly one is lost
    for name in ("sf0.001", "sf0.01"):
        table = spark.read.parquet(f"/root/testdata/{name}/documents.parquet")
        rows_ = [(x["doc_id"], x["text"]) for x in exact.deduplicate(table).select("doc_id", "text").collect()]
        pairs = near_pairs([t for _, t in rows_])
        want = {rows_[i][0] for i in first_of_each([i for i, _ in rows_], pairs)}
        got = {x["doc_id"] for x in near_copies.one_of_each(spark.createDataFrame(rows_, "doc_id long, text string")).select("doc_id").collect()}
        assert pairs and want <= got and len(got - want) <= 0.1 * (len(rows_) - len(want)), name
    kept = near_copies.one_of_each(docs)
    assert kept.columns == docs.columns
    pairs = near_pairs([t for _, t in rows()])
    assert Counter(k["doc_id"] for k in kept.collect()) == Counter(rows()[i][0] for i in first_of_each([i for i, _ in rows()], pairs))
    assert near_copies.one_of_each(none).count() == 0


def test_near_copies_of_cut_cells(spark, monkeypatch):
    """Cells that lie in several ranges: their pieces are linked by their first rows."""
    line = [f"x{i}" for i in range(50)]
    data = [(i, " ".join([*line, f"end{i}"])) for i in range(300)]
    own = spark.createDataFrame(data, "doc_id long, text string").select("doc_id", "text", near_copies.digest(F.col("text")).alias("digest"))
    signed = near_copies.signatures(own).withColumn("_row", F.monotonically_increasing_id())
    cells = signed.select("_row", "fp", F.posexplode("bands").alias("i", "band")).where("i < 3").withColumn("bands", F.array("band"))
    keys = ["spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions"]
    before = [spark.conf.get(k) for k in keys]
    try:
        spark.conf.set(keys[0], "false")
        spark.conf.set(keys[1], "40")
        found = near_copies.components(near_copies.links(near_copies.materialise(cells.select("_row", "fp", "bands").groupBy("_row", "fp").agg(F.flatten(F.collect_list("bands")).alias("bands")), "signed")))
        assert found.select("root").distinct().count() == 1 and found.count() == 299
    finally:
        for k, v in zip(keys, before):
            spark.conf.set(k, v)


@pytest.mark.parametrize("crowd", [20_000, 12])
def test_every_link_is_found(spark, monkeypatch, crowd):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    r, fps = random.Random(4), set()
    for _ in range(60):
        f = r.getrandbits(64)
        for _ in range(r.choice([1, 2, 40])):
            for b in r.sample(range(64), r.randint(0, 4)):
                f ^= 1 << b
            fps.add(f)
    fps = sorted(fps)
    points = spark.createDataFrame([(simhash.signed(f),) for f in fps], "fp long")
    for n in (len(fps), 10 ** 9):  # coarse and fine cells
        edges = [(e["a"] % (1 << 64), e["b"] % (1 << 64)) for e in simhash.links(points, n).collect()]
        assert all((a ^ b).bit_count() <= 3 or crowd for a, b in edges)
        parent = {f: f for f in fps}

        def root(f):
            while parent[f] != f:
                f = parent[f]
            return f
        for a, b in edges:
            parent[max(root(a), root(b))] = min(root(a), root(b))
        assert [fps.index(root(f)) for f in fps] == brute_components(fps)


def test_chains_end_in_one_component(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 102), (200, 100)], "a long, b long")
    got = {r["node"]: r["root"] for r in simhash.components(chain).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 101: 100, 102: 100, 200: 100}


# ---- toxicity ----------------------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def talk(spark):
    r = random.Random(6)
    syllables = ["ka", "lo", "mi", "ten", "sur", "pa", "ri", "don"]
    word = lambda: "".join(r.choices(syllables, k=r.randint(1, 3)))
    data = []
    for i in range(900):
        words, bad = [word() for _ in range(60)], i % 6 == 0
        if bad:
            words[r.randrange(60)] = r.choice(["blockhead", "nitwit", "grobian"])
        data.append((i, " ".join(words), int(bad)))
    return spark.createDataFrame(data, "doc_id long, text string, toxic int")


def test_toxic_rows_of_the_held_out_fold(talk, docs, none):
    model = toxicity.train(talk.select("doc_id", "text"), talk.select("doc_id", "toxic"))
    got = toxicity.classify(talk, model).join(talk.select("doc_id", "toxic"), "doc_id").toPandas()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]).all()
    held = got[got.held_out]
    assert (held.predicted == held.toxic).mean() > 0.97 and held.score.between(0, 1).all()
    odd = toxicity.classify(docs, model).collect()
    assert len(odd) == len(rows()) and all(r["predicted"] == (r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in odd)
    assert toxicity.without_toxic(docs, model).columns == docs.columns
    assert toxicity.classify(none, model).count() == 0
    unlabelled = toxicity.train(talk.select("doc_id", "text"), talk.select("doc_id", "toxic").limit(0))
    assert toxicity.classify(docs, unlabelled).select("score").distinct().count() == 1


# ---- licences ----------------------------------------------------------------------------------------------------------

@pytest.mark.parametrize(("line", "ids", "permissive"), [
    ("MIT", {"mit"}, True), ("MIT OR GPL-2.0", {"mit", "gpl-2.0"}, True), ("MIT and GPL-2.0", {"mit", "gpl-2.0"}, False), ("GPL-3.0 or MIT AND BSD-3-Clause", {"gpl-3.0", "mit", "bsd-3-clause"}, True),
    ("(GPL-3.0 or MIT) and LGPL-2.1", {"gpl-3.0", "mit", "lgpl-2.1"}, False), ("GPL-2.0-only WITH Classpath-exception-2.0 */", {"gpl-2.0-only with classpath-exception-2.0"}, False)])
def test_expressions(line, ids, permissive):
    assert licences.parse(line)[:2] == (ids, permissive)


@pytest.mark.parametrize("line", ["", "or MIT", "MIT or", "(MIT", "MIT)", "MIT GPL", "()", "(MIT or GPL) with x"])
def test_broken_expressions(line):
    assert licences.parse(line) is None


def test_licence_places(spark, docs, none):
    data = [(1, "x under the MIT-license under the mit license. CC-BY-NC"), (2, "// SPDX-License-Identifier: MIT OR Apache-2.0\ncode"), (3, "Apache License, Version 2.0"), (4, "éunder the mit license"),
            (5, "SPDX-License-Identifier: MIT OR"), (6, None), (7, "all rights reserved")]
    got = {r["doc_id"]: tuple(r)[1:] for r in licences.digest(licences.scan(spark.createDataFrame(data, "doc_id long, text string"))).collect()}
    assert got[1] == (12, 3, 1, 9, "cc-by-nc,mit", "cc-by-nc,mit", 0.9)
    assert got[2][1:] == (0, None, None, "", "apache-2.0,mit", 1.0)
    assert got[3] == (5, 1, 0, 0, "apache-2", "apache-2", 0.9)
    assert got[4][1] == 0 and got[5][5:] == ("", 0.0) and got[6] == (0, 0, None, None, "", "", 0.0) and got[7][5:] == ("reserved", 0.7)
    assert licences.scan(docs).count() == len(rows()) and licences.scan(none).count() == 0


# ---- fingerprints ------------------------------------------------------------------------------------------------------

def test_paragraphs_are_added_and_taken_out():
    h = fingerprints.Hasher()
    a, b, both = h.of("one two three four five six\nseven"), h.of("and one more paragraph of words"), h.of("and one more paragraph of words\nseven\none two three four five six")
    assert str(a + b) == str(both) and str(both - b) == str(a) and str(h.of("")) == str(a - a)
    assert str(h.of("x y")) != str(h.of("y x")) and both.likeness(both) == 1 and h.of("").likeness(h.of("")) == 1


def test_edited_forms(docs, none):
    ordered = sorted(rows(), key=lambda r: (r[0] is not None, r[0] or 0, text(r[1])))
    want = []
    for (i, t), (_, n) in zip(ordered, [*ordered[1:], ordered[0]]):
        k = len(text(t)) // 2
        want.append((i, len(text(t)), hashlib.sha256((text(t)[:len(text(t)) - k] + text(n)[:k]).encode()).hexdigest()))
    got = fingerprints.with_next(docs).collect()
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == Counter(want)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    plain = {(r["doc_id"], r["fingerprint"]) for r in fingerprints.fingerprint(docs).collect()}
    assert plain == {(r["doc_id"], r["fingerprint"]) for r in got}
    assert fingerprints.with_next(none).count() == 0


def test_ranges_meet(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_BYTES", 200)
    data = [(i * 3, f"text number {i} " * (i % 5)) for i in range(200)]
    got = {r["doc_id"]: r["edited_sha256"] for r in fingerprints.with_next(spark.createDataFrame(data, "doc_id long, text string").repartition(4)).collect()}
    assert got == {i: hashlib.sha256(fingerprints.edited(t, data[(k + 1) % len(data)][1]).encode()).hexdigest() for k, (i, t) in enumerate(data)}


# ---- language ----------------------------------------------------------------------------------------------------------

def test_languages(spark, docs, none):
    r = random.Random(7)
    data = [(i, " ".join(r.sample((ENGLISH if i % 2 else FRENCH).split(), 8)), "en" if i % 2 else "fr") for i in range(120)]
    train = spark.createDataFrame([*data, (500, None, "en"), (501, "no language here", None)], "doc_id long, text string, lang string")
    model = language.train(train)
    assert sorted(model[0]) == ["en", "fr"]
    got = {r["doc_id"]: r for r in language.predict(train, model).collect()}
    assert sum(got[i]["lang_pred"] == x for i, _, x in data if got[i]["held_out"]) >= 0.97 * sum(got[i]["held_out"] for i, _, _ in data)
    odd = {r["doc_id"]: r for r in language.predict(docs, model).collect()}
    assert [odd[i]["lang_pred"] for i in (1, 2, 3, 13, 14, 15)] == ["und", "und", "und", "en", "fr", "und"]
    assert language.known(docs, model).columns == docs.columns and language.predict(none, model).count() == 0
    assert [r["lang_pred"] for r in language.predict(docs.where("doc_id = 13"), language.train(none)).collect()] == ["und"]


def test_every_language_is_learned(spark):
    r = random.Random(10)
    lines = {f"l{k}": [chr(0x100 + 26 * k + j) * 3 for j in range(20)] for k in range(7)}  # l0 is the most frequent, l6 the rarest
    data = [(100 * k + i, " ".join(r.choices(words, k=12)), lang) for k, (lang, words) in enumerate(lines.items()) for i in range(30 - 3 * k)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    names, blocks = model = language.train(docs, 3)
    assert sorted(names) == list(lines) and [b.shape for b in blocks] == [(language.BUCKETS, 3), (language.BUCKETS, 3), (language.BUCKETS, 1)]
    _, (whole,) = language.train(docs)
    assert np.array_equal(np.concatenate(blocks, axis=1), whole)
    got = language.predict(docs, model).join(docs, "doc_id").where("held_out").collect()
    assert {g["lang"] for g in got} == set(lines) and all(g["lang_pred"] == g["lang"] for g in got)


def test_counts_beside_a_dictionary():
    codes = language.lowered("Ab, é9")
    assert "".join(map(chr, codes)) == " ab é "
    want = Counter()
    for n in language.ORDERS:
        for i in range(len(codes) - n + 1):
            h = 0
            for c in codes[i:i + n].tolist():
                h = (h * 0x9E3779B97F4A7C15 + c) * 0xC2B2AE3D27D4EB4F % (1 << 64)
            want[(h >> 40) % language.BUCKETS] += 1
    assert Counter(language.grams(codes).tolist()) == want


# ---- language model ----------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_beside_the_formula(docs, none, order):
    tokens = [[*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text(t))), "\n"] for _, t in rows()]
    learn = [i is not None and zlib.crc32(str(i).encode()) % 10 != 0 for i, _ in rows()]
    count, history = Counter(), Counter()
    for t in (t for t, k in zip(tokens, learn) if k):
        line = ["<"] * (order - 1) + t
        for i in range(order - 1, len(line)):
            for n in range(1, order + 1):
                count[tuple(line[i - n + 1:i + 1])] += 1
                history[n, tuple(line[i - n + 1:i])] += 1
    single = {k[0]: c for k, c in count.items() if len(k) == 1}
    total, distinct = sum(single.values()), len(single)
    once, twice = (sum(c == k for c in single.values()) for k in (1, 2))
    discount = once / (once + 2 * twice) if once and twice else 0.5

    def prob(line, i, n):
        if n == 1:
            return (single[line[i]] - discount) / total if line[i] in single else discount * distinct / total
        before = tuple(line[i - n + 1:i])
        return (count[(*before, line[i])] + scoring.PRIOR * prob(line, i, n - 1)) / (history[n, before] + scoring.PRIOR)

    want = []
    for (i, _), t, k in zip(rows(), tokens, learn):
        line = ["<"] * (order - 1) + t
        want.append((str(i), not k, len(t), sum(w in single for w in t), total, round(sum(math.log10((single.get(w, 0) + 0.1) / (total + 0.1 * (distinct + 1))) for w in t), 5),
                     round(sum(math.log10(prob(line, j, order)) for j in range(order - 1, len(line))), 5)))
    got = [(str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5), round(r["score"], 5)) for r in scoring.score(docs, order).collect()]
    assert [g[:5] for g in sorted(got)] == [w[:5] for w in sorted(want)]
    assert np.allclose([g[5:] for g in sorted(got)], [w[5:] for w in sorted(want)], atol=1e-3)
    assert scoring.score(none, order).count() == 0


# ---- the pipeline ------------------------------------------------------------------------------------------------------

def test_pipeline_beside_plain_versions(spark):
    import corpus_pipeline as p

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, stage in p.STAGES:
        before, docs = docs, stage(spark, docs, folder).persist()
        kept[name] = docs.toPandas()
        if name != "packing":
            assert docs.columns == before.columns and docs.dtypes == before.dtypes
    assert len(kept["language"]) == len(kept["toxicity"])  # all have letters of a known language
    texts = kept["language"].assign(n=kept["language"].text.map(normalised)).sort_values("doc_id")
    assert sorted(kept["exact_dedup"].doc_id) == sorted(texts.drop_duplicates("n").doc_id)
    left = kept["exact_dedup"].sort_values("doc_id").reset_index(drop=True)
    stay = first_of_each(left.doc_id.tolist(), near_pairs(left.text.tolist()))
    assert sorted(kept["simhash_near_dedup"].doc_id) == sorted(left.doc_id[stay])
    assert set(kept["packing"].doc_id) == set(kept["simhash_near_dedup"].doc_id)
    labels = pd.read_parquet(f"{folder}/labels.parquet")
    toxic = set(labels[labels.toxic == 1].doc_id)
    lost = set(pd.read_parquet(f"{folder}/documents.parquet").doc_id) - set(kept["toxicity"].doc_id)
    assert len(lost & set(labels[labels.toxic == 0].doc_id)) <= 0.05 * len(labels) and (not toxic or lost & toxic or len(toxic) < 20)
    assert p.run(spark, folder).count() == len(kept["packing"])
