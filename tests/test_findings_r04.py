"""What round 4 found, each on rows of its own."""

import random
from collections import Counter
from math import log1p

from plumbline.operators import leakage, retrieval


def test_near_copies_write_no_sets_that_cannot_be_near(spark, monkeypatch):
    """Short texts beside long ones: sets whose size no text allows are not written, repeated sets are compared once, rows are those of all pairs."""
    written, plain = {}, leakage.materialise

    def counted(df, label):
        done = plain(df, label)
        written[label] = done.count()
        return done

    monkeypatch.setattr(leakage, "materialise", counted)
    r = random.Random(11)
    phrases = [" ".join(r.choices([f"w{i}" for i in range(50)], k=6)) for _ in range(12)]
    line = lambda k: " ".join([r.choice(phrases)] + [f"u{r.randrange(9 ** 9)}" for _ in range(k)] + [r.choice(phrases)])
    short = [line(r.randint(0, 12)) for _ in range(80)]
    bench = short[:30] + [s + " more of it" for s in short[20:50]] + [line(200) for _ in range(70)] + short[:5]
    rows = list(enumerate(short)) + [(200, short[3]), (201, "w1 w2"), (None, short[4])]
    grams = lambda t: {tuple(w[i:i + 3]) for w in [t.split()] for i in range(len(w) - 2)}
    want = {}
    for i, t in rows:
        best = max((len(x & y) / len(x | y) for b in bench if (x := grams(t)) and (y := grams(b))), default=0)
        if best >= 0.5:
            want[i] = max(best, want.get(i, 0))
    got = leakage.near_copies(spark.createDataFrame(rows, "id long, text string").repartition(3), spark.createDataFrame([(b,) for b in bench], "text string"), "id")
    found = {x["id"]: x["jaccard"] for x in got.collect()}
    assert len(want) > 50 and found.keys() == want.keys() and all(abs(found[k] - v) < 1e-9 for k, v in want.items())
    assert written["bench_sets"] == 65  # before, all 135
    none = leakage.near_copies(spark.createDataFrame([(1, "one two")], "id long, text string"), spark.createDataFrame([(b,) for b in bench], "text string"), "id")
    assert none.count() == 0


def test_blocks_hand_on_only_what_reaches_the_first_blocks_score(spark, monkeypatch):
    """Rare and frequent words, equal texts, two corpora, words that no passage has: as brute force, and few rows leave the blocks."""
    monkeypatch.setattr(retrieval, "BLOCK", 32)
    monkeypatch.setattr(retrieval, "ASKS", 16, raising=False)
    written, plain = {}, retrieval.materialise

    def counted(df, label):
        done = plain(df, label)
        written[label] = done.count()
        return done

    monkeypatch.setattr(retrieval, "materialise", counted)
    r = random.Random(21)
    words = [f"word{i}x" for i in range(120)]
    weights = [120 / (i + 1) for i in range(120)]
    texts = [r.choices(words, weights, k=r.randint(1, 30)) for _ in range(300)]
    texts += texts[:30]  # equal scores in several blocks
    keys = [("c", f"d{i % 60:02d}", i) for i in range(330)]
    asked = [r.choices(words, weights, k=r.randint(1, 12)) + ["unknown"] * (q % 2) for q in range(50)]
    table = spark.createDataFrame([(*k, " ".join(t)) for k, t in zip(keys, texts)] + [("e", "e1", n, "word1x alone") for n in range(9)], "corpus string, doc string, n int, text string")
    queries = spark.createDataFrame([(q, "c", " ".join(w)) for q, w in enumerate(asked)] + [(900, "e", "alone"), (901, "e", "unknown"), (902, None, "alone"), (903, "c", None)], "q long, corpus string, query string")
    found = retrieval.search(queries, retrieval.write_index(table, "corpus", ["doc", "n"]), "q", 4).collect()
    df, mean = Counter(w for t in texts for w in set(t)), sum(map(len, texts)) / len(texts)
    for q, w in enumerate(asked):
        total = Counter()
        for key, t in zip(keys, texts):
            for x in set(w) & set(t):
                total[key[1:]] += log1p((330 - df[x] + 0.5) / (df[x] + 0.5)) * t.count(x) * 2.2 / (t.count(x) + 1.2 * (0.25 + 0.75 * len(t) / mean))
        want = sorted(((round(s, 9), key) for key, s in total.items()), key=lambda x: (-x[0], x[1]))[:4]
        got = {x["rank"]: ((x["doc"], x["n"]), x["score"]) for x in found if x["q"] == q}
        assert [got[k + 1][0] for k in range(len(want))] == [key for _, key in want] and all(abs(got[k + 1][1] - s) < 1e-8 for k, (s, _) in enumerate(want)), w
    assert [(x["doc"], x["n"]) for x in sorted(found, key=lambda x: x["rank"]) if x["q"] == 900] == [("e1", n) for n in range(4)]
    assert not [x for x in found if x["q"] > 900]
    assert sum(written.get(x, 0) for x in ("first_best", "block_best")) < 1600  # before, up to 4 of each of 11 blocks
