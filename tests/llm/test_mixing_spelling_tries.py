"""Mixing, spelling variants and the conversation trie beside brute-force versions, on rows with nulls, empty and long texts, ties, repeats, hot
groups and clashing names."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from plumbline.llm import conversations, mixing, queries, spelling

SPACES = r"[^\x20\x09-\x0D]+"


def clashing(df, names):
    return df.withColumns({c: F.lit(f"{c}!") for c in names})


# ---- mixing ------------------------------------------------------------------------------------------------------------

def brute_targets(sizes, weights=(5, 2, 1), most=3):
    """By the contract's own words: share, stop at the cap, share the excess again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, open_ones, left = dict.fromkeys(sizes, 0.0), set(sizes), float(sum(sizes.values()))
    while left > 1e-9 and open_ones:
        w = sum(weight[s] for s in open_ones)
        for s in open_ones:
            target[s] += left * weight[s] / w
        left = 0.0
        for s in list(open_ones):
            if target[s] > most * sizes[s]:
                left += target[s] - most * sizes[s]
                target[s] = float(most * sizes[s])
                open_ones.discard(s)
    return target


def brute_rates(sizes, target, most=3):
    """The tilt by halving, on the documents one by one."""
    total = sum(sizes)
    if not total:
        return [1.0] * len(sizes)
    scale = sum(x * x for x in sizes) / total
    rate = lambda t, x: min(float(most), math.exp(min(700.0, t * x / scale)))
    low, high = -1e4, math.log(most) * scale / min(x for x in sizes if x)
    for _ in range(300):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(x * rate(mid, x) for x in sizes) < target else (low, mid)
    return [rate(high, x) for x in sizes]


def mixing_rows():
    r = random.Random(11)
    text = lambda k: " ".join(f"w{r.randrange(50)}" for _ in range(k))
    sources = ["b", "a", None, "é", "B", "z", "empty", "tiny"]
    rows = [(i, text(int(r.lognormvariate(3, 1))), r.choice(sources[:6])) for i in range(600)]
    rows += [(1000 + i, "same three words", "hot") for i in range(900)]  # a third of all rows in one class
    rows += [(3000, None, "empty"), (3001, " \n\t", "empty"), (3002, "one", "tiny"), (None, "no id here", "a"), (None, None, None), (3003, text(5000), "b"), (3004, "twice", "a"), (3004, "twice", "a")]
    return rows


def test_mix_beside_plain_versions(spark):
    rows = mixing_rows()
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5), ["size", "key", "n", "copies", "rate", "target", "_at", "_hash", "position"])
    got = mixing.mix(docs).withColumn("s", F.lit(0)).collect()
    size = lambda t: len(re.findall(SPACES, t or ""))
    by = defaultdict(list)
    for _, t, s in rows:
        by[s].append(size(t))
    target = brute_targets({s: sum(x) for s, x in by.items()})
    assert Counter((str(g["doc_id"]), g["size"], g["source_size"], round(g["target"], 6)) for g in got) == Counter((str(i), size(t), sum(by[s]), round(target[s], 6)) for i, t, s in rows)
    assert math.isclose(sum(target.values()), sum(map(sum, by.values())))
    assert all(g["taken"] == g["copies"] * g["size"] and 0 <= g["copies"] <= 3 for g in got)
    rates = {s: dict(zip(x, brute_rates(x, target[s]))) for s, x in by.items()}
    of = {(i, size(t)): s for i, t, s in rows}
    assert all(math.isclose(g["rate"], rates[of[g["doc_id"], g["size"]]][g["size"]], rel_tol=1e-3) for g in got if g["size"] and g["doc_id"] is not None)
    for s, x in by.items():
        taken = sum(g["taken"] for g in got if of[g["doc_id"], g["size"]] == s)
        assert abs(taken - target[s]) <= max(2.0, 0.002 * target[s]), s
    again = mixing.mix(docs.repartition(2, "text")).collect()
    key = lambda g: (str(g["doc_id"]), g["taken"], g["target"])
    assert Counter(map(key, got)) == Counter(map(key, again))


def test_targets_stop_and_go_on_stopping(spark):
    for sizes in [{"a": 1, "b": 1, "c": 1000}, {"a": 0, "b": 5}, {"a": 10, "b": 1, "c": 100, "d": 3, "e": 4000, None: 7}, {"a": 0}, {}]:
        sources = spark.createDataFrame([(f"s{s}" if s is not None else "t", n) for s, n in sizes.items()], "key string, source_size long")
        got = {(r["key"][1:] if r["key"] != "t" else None): r["target"] for r in mixing.targets(sources).collect()}
        want = brute_targets(sizes)
        assert got.keys() == want.keys() and all(math.isclose(got[s], want[s], abs_tol=1e-6) for s in want)


def test_mix_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(docs).count() == 0
    blank = mixing.mix(spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id int, text string, source string")).collect()
    assert [(g["size"], g["target"], g["taken"]) for g in blank] == [(0, 0.0, 0)] * 2


# ---- spelling ----------------------------------------------------------------------------------------------------------

def brute_words(rows, least=3):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= least}


def one_edit(u, v):
    if len(u) > len(v):
        u, v = v, u
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v)) == 1
    return len(v) == len(u) + 1 and any(v[:i] + v[i + 1:] == u for i in range(len(v)))


def brute_variants(rows):
    n = brute_words(rows)
    near = {w: [x for x in n if abs(len(x) - len(w)) <= 1 and one_edit(w, x)] for w in n}
    best = {w: min(x, key=lambda y: (-n[y], y)) if x else None for w, x in near.items()}
    form = {w: b if b and n[b] >= 2 * n[w] else None for w, b in best.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w
    return {(w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def spelling_rows():
    r = random.Random(12)
    words = ["aaaaa", "aaaaaa", "aaaaaaa", "aabaa", "abaaaa", "ÀÉéèü", "ÀÉéèu", "straße", "strasse", "strase", "colour", "color", "colours", "x" * 3000, "x" * 3001]
    words += ["".join(r.choices("abé", k=r.randint(4, 8))) for _ in range(250)]
    texts = [" ".join(w if r.random() < 0.6 else w.title() for w in r.choices(words, weights=[1 + 40 / (i + 1) for i in range(len(words))], k=120)) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[0]), (5, texts[5]), (90, None), (91, ""), (92, "1234 日本 ×÷abcd"), (93, texts[1] * 30)]
    return rows + [(1000 + i, "hottie hottie hotties") for i in range(500)]


def test_variants_beside_all_pairs(spark, monkeypatch):
    rows = spelling_rows()
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), ["word", "n", "form", "root", "best", "m", "path"])
    want = brute_variants(rows)
    assert any(f for _, f, *_ in want) and any(f and r != f for _, f, r, *_ in want)
    for together, held in [(20_000, 200_000), (3, 5)]:
        monkeypatch.setattr(spelling, "TOGETHER", together)
        monkeypatch.setattr(spelling, "HELD_WORDS", held)
        got = [tuple(r) for r in spelling.variants(docs).collect()]
        assert len(got) == len(want) and set(got) == want
    assert spelling.variants(docs.limit(0)).count() == 0


def test_acceptors_are_minimal_and_compose():
    r = random.Random(13)
    for letters, k in [("ab", 7), ("abcd", 6), ("a", 9)]:
        words = sorted({"".join(r.choices(letters, k=r.randint(1, k))) for _ in range(300)})
        a = spelling.Acceptor(words)
        ends = {}  # right languages: equal ones must be one state

        def language(q):
            if q not in ends:
                ends[q] = frozenset(([""] if a.final[q] else []) + [c + e for c, x in a.arcs[q] for e in language(x)])
            return ends[q]
        assert language(a.start) == set(words) and len(set(ends.values())) == len(ends)
        got = [tuple(sorted(p)) for p in a.pairs(0)]
        assert len(got) == len(set(got)) and set(got) == {(u, v) for u in words for v in words if u < v and one_edit(u, v)}
    assert list(spelling.Acceptor([]).pairs(0)) == []


# ---- conversations -----------------------------------------------------------------------------------------------------

def brute_trie(rows):
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            key = hashlib.sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).hexdigest()
            own[c].append((t is not None, t or 0, key, role or "", text or ""))
    turns = {c: [(r, x) for *_, r, x in sorted(v)] for c, v in own.items()}
    made = {}
    for c, v in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        made[c] = (*turns.get(c - c % 20, [])[:h], *v[h:])
    members, children = defaultdict(list), Counter()
    for c, s in made.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    children.update(n[:-1] for n in members if n)
    saved, leaves = Counter(), Counter()
    for n, m in members.items():
        for d in range(len(n) + 1):
            saved[n[:d]] += (len(m) - 1) * (len(re.findall(SPACES, n[-1][1])) if n else 0)
            leaves[n[:d]] += not children[n]
    return Counter((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), children[n], leaves[n], saved[n],
                    hashlib.sha256(",".join(map(str, sorted(c for c in m if len(made[c]) == len(n)))).encode()).hexdigest()) for n, m in members.items())


def conversation_rows():
    r = random.Random(14)
    said = [("user", "hello there"), ("assistant", "hello how can I help"), ("user", "tell me more"), (None, "no role"), ("user", None), ("user", ""), ("assistant", "a b c d e f")]
    rows = []
    for c in [*range(0, 150), *range(400, 430)]:
        if c in (40, 60):  # no conversation that starts others
            continue
        start = [said[k % len(said)] for k in range(r.choice([0, 2, 5]))]
        rows += [(c, t, *x) for t, x in enumerate(start + r.choices(said, k=r.choice([1, 2, 3, 12])))]
    rows += [(c, t, *said[t % 4]) for c in range(500, 560) for t in range(25)]  # copies, three blocks long
    rows += [(700, t, "user", f"turn {t % 5}") for t in range(900)] + [(701, t, "user", f"turn {t % 5}") for t in range(901)]
    rows += [(801, None, "user", "late"), (801, None, "user", "late"), (801, 3, "user", "x"), (801, 3, "user", "y"), (801, -1, "user", "z"), (None, 1, "user", "of nobody"), (802, 0, "user", "word " * 20_000)]
    return rows


def test_trie_beside_plain_version(spark, monkeypatch):
    rows = conversation_rows()
    table = clashing(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4), ["at", "d", "t1", "words", "depth", "block", "_at", "n1"])
    want = brute_trie(rows)
    assert any(k[1] > 0 and k[4] > 1 for k in want)
    for chunk, piece in [(4096, 1 << 20), (3, 40)]:
        monkeypatch.setattr(conversations, "CHUNK", chunk)
        monkeypatch.setattr(conversations, "PIECE_BYTES", piece)
        assert Counter(tuple(r) for r in conversations.trie(table).collect()) == want
    assert conversations.trie(table.limit(0)).count() == 0


def test_conversations_without_turns(spark):
    rows = [(c, 0, "user", f"only {c}") for c in range(1, 15)]  # conversation 0 is missing: those with h > 0 lose their only turn
    table = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    assert Counter(tuple(r) for r in conversations.trie(table).collect()) == brute_trie(rows)


# ---- the registered queries --------------------------------------------------------------------------------------------

@pytest.mark.parametrize(("name", "columns"), [
    ("op11_mixing", {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"}),
    ("op12_spelling", {"word": "string", "form": "string", "root": "string", "n": "bigint", "n_near": "bigint", "form_n": "bigint"}),
    ("op13_trie", {c: "bigint" for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")} | {"ends_sha256": "string"})])
def test_queries_over_a_table(spark, name, columns):
    folder = "/root/testdata/sf0.001"
    got = queries.QUERIES[name](spark, folder)
    assert columns.items() <= dict(got.dtypes).items()
    table = spark.read.parquet(f"{folder}/{'conversations' if name == 'op13_trie' else 'documents'}.parquet")
    if name == "op11_mixing":
        p, d = got.toPandas(), table.select("doc_id", "source").toPandas()
        by = p.merge(d, on="doc_id").groupby("source", dropna=False).agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"))
        assert len(p) == len(d) and by.target.round(6).to_dict() == {s: round(t, 6) for s, t in brute_targets(by["size"].to_dict()).items()}
        assert ((by.taken - by.target).abs() <= 0.01 * by.target + 10).all()
    elif name == "op12_spelling":
        assert {tuple(r) for r in got.collect()} == brute_variants([tuple(r) for r in table.select("doc_id", "text").collect()])
    else:
        assert Counter(tuple(r) for r in got.collect()) == brute_trie([tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()])
