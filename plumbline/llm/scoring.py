"""Language-model scoring with a weighted backoff automaton.

Counting: documents are dealt into blocks of bounded size; a block sums its n-grams (64-bit hashes) and sends them, cut into ranges of
the hash, to where the ranges are summed over all blocks. What goes back to a block is the corpus count of each n-gram it asked for,
so no task and no broadcast ever holds the whole model, and a frequent n-gram is one row per block.

Scoring: the block's n-grams become an automaton. A state is a history, an arc a word seen after it, and a failure arc leads to the
history without its first word; every text is read once from left to right, the state is carried along and log-probabilities add up.

Smoothing, words: (c - D) / N, and D * V / N for an unknown one (absolute discounting). Longer n-grams:
p(w | h) = (c(hw) + PRIOR * p(w | h')) / (c(h) + PRIOR) with h' = h without its first word, which sums to one over words. A seen w has
an arc of that weight; PRIOR / (c(h) + PRIOR) is the weight of the failure arc.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from plumbline.llm.common import fold, parts_for, text_bytes, texts, utf8
from plumbline.session import materialise

ORDER, PRIOR = 2, 500.0
FOLDS, HELD_OUT = 10, 0
BLOCK_BYTES, RANGE_BYTES = 8 << 20, 12 << 20
START, END = 0, 1
NO_WORDS = (b"\n<", b"\n>")  # no word holds a line break
ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Block:
    """The n-grams of a block's texts. Each text is ORDER - 1 start marks, its words and an end; `at` are the positions that
    are predicted, `heads` the last start mark of each text."""

    def __init__(self, column: pa.Array, learn: np.ndarray, order: int):
        import xxhash

        data, offsets = utf8(column)
        ids: dict[bytes, int] = {w: i for i, w in enumerate(NO_WORDS)}
        tokens: list[int] = []
        self.order, self.lengths = order, np.zeros(len(column), np.int64)
        for i in range(len(column)):
            words = data[offsets[i]:offsets[i + 1]].tobytes().lower().split()  # A-Z alone are lowered, ASCII white space splits
            tokens += [START] * (order - 1)
            tokens += [ids.setdefault(w, len(ids)) for w in words]
            tokens.append(END)
            self.lengths[i] = len(words) + 1
        self.tokens, self.words = np.array(tokens, np.int64), len(ids)
        ends = np.cumsum(self.lengths + order - 1)
        self.heads = ends - self.lengths - 1  # before the first predicted position; counts as a history for orders below `order`
        predicted = np.ones(len(tokens), bool)
        for k in range(order - 1):
            predicted[self.heads - k] = False
        self.at = np.flatnonzero(predicted)
        self.starts = np.cumsum(self.lengths) - self.lengths  # of each text within `at`
        counted = np.zeros(len(tokens), bool)
        counted[self.at] = np.repeat(learn, self.lengths)
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, ids), np.uint64, len(ids))[self.tokens]
        self.start_key = mixed(np.array([xxhash.xxh3_64_intdigest(NO_WORDS[START])], np.uint64) * ODD[0] + np.uint64(1))[0]
        self.keys, self.seen, self.here = [], [], []  # per order: distinct keys, their counts in texts to learn from, index by position
        for n in range(1, order + 1):
            where = self.at if n == order else np.union1d(self.at, self.heads)
            total = np.full(len(where), n, np.uint64)
            for k in range(n):
                total += hashes[where - k] * ODD[k]
            keys, inverse = np.unique(mixed(total), return_inverse=True)
            weight = counted[where] if n == order else counted[where] | np.isin(where, self.heads[learn])
            here = np.full(len(tokens), -1, np.int64)
            here[where] = inverse
            self.keys.append(keys)
            self.seen.append(np.bincount(inverse, weights=weight, minlength=len(keys)).astype(np.int64))
            self.here.append(here)


def planes(values: np.ndarray) -> bytes:
    """Sorted numbers as byte planes of their differences: the upper planes are nearly all zeros, which compress."""
    return np.diff(values, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def unplanes(raw: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def shortened(counts: np.ndarray) -> tuple[bytes, bytes]:
    """A byte a count, and those from 255 on apart."""
    large = counts >= 255
    return np.where(large, 255, counts).astype(np.uint8).tobytes(), counts[large].astype("<i8").tobytes()


def lengthened(short: bytes, large: bytes) -> np.ndarray:
    out = np.frombuffer(short, np.uint8).astype(np.int64)
    out[out == 255] = np.frombuffer(large, "<i8")
    return out


ASKED = "block int, n int, part int, keys binary, short binary, large binary"
SUMMED = "block int, n int, part int, short binary, large binary, tokens long, words long, once long, twice long"


def rows(columns: list[str], schema: str, values: list[tuple]) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64()}
    types = dict(x.split() for x in schema.split(", "))
    return pa.table([pa.array([v[i] for v in values], kinds[types[c]]) for i, c in enumerate(columns)], names=columns)


def asked(parts: int, order: int):
    """What a block asks for: its n-grams by range of their hash, with its own counts."""
    names = [x.split()[0] for x in ASKED.split(", ")]

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        own = Block(column(table, "text"), column(table, "learn").to_numpy(zero_copy_only=False), order)
        number, out = table.column("block")[0].as_py(), []
        for n, (keys, seen) in enumerate(zip(own.keys, own.seen), 1):
            cuts = np.searchsorted(ranges(keys, parts), np.arange(parts + 1))
            out += [(number, n, p, planes(keys[a:b]), *shortened(seen[a:b])) for p, (a, b) in enumerate(zip(cuts.tolist(), cuts[1:].tolist())) if b > a]
        return rows(names, ASKED, out)
    return run


def column(table: pa.Table, name: str) -> pa.Array:
    chunks = table.column(name).chunks
    return chunks[0] if len(chunks) == 1 else pa.concat_arrays(chunks)


def ranges(keys: np.ndarray, parts: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


def summed(start_key: int):
    """A range's sums over all blocks, for each block in the order it asked; for single words also what smoothing needs."""
    names = [x.split()[0] for x in SUMMED.split(", ")]

    def run(table: pa.Table) -> pa.Table:
        asked_for = table.select(["block", "n", "part", "keys", "short", "large"]).to_pylist()
        keys = [unplanes(r["keys"]) for r in asked_for]
        distinct, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(inverse, weights=np.concatenate([lengthened(r["short"], r["large"]) for r in asked_for]), minlength=len(distinct)).astype(np.int64)
        at, out = 0, []
        for r, k in zip(asked_for, keys):
            out.append((r["block"], r["n"], r["part"], *shortened(total[inverse[at:at + len(k)]]), None, None, None, None))
            at += len(k)
        if asked_for[0]["n"] == 1:
            words = total[(total > 0) & (distinct != np.uint64(start_key))]
            out.append((-1, 1, asked_for[0]["part"], b"", b"", int(words.sum()), len(words), int((words == 1).sum()), int((words == 2).sum())))
        return rows(names, SUMMED, out)
    return run


class Automaton:
    """States: 0 is the empty history, then the seen histories of each order. Arcs are looked up by state and word."""

    def __init__(self, own: Block, counts: list[np.ndarray], tokens: int, words: int, discount: float, prior: float):
        self.width = own.words
        first = np.cumsum([1, *map(len, own.keys[:-1])])  # state of the first n-gram of each order below the highest
        known = max(tokens, 1)
        floor = discount * words / known if words else 1.0
        prob = np.where(counts[0] > 0, (counts[0] - discount) / known, floor)
        self.unknown = float(np.log10(floor))
        self.fail, self.drop = [0], [0.0]
        self.arcs: dict[int, tuple[float, int]] = {}
        for n in range(1, own.order + 1):
            here, count = own.here[n - 1], counts[n - 1]
            some = np.zeros(len(count), np.int64)  # a position of each n-gram
            some[here[here >= 0]] = np.flatnonzero(here >= 0)
            if n > 1:
                shorter = own.here[n - 2]
                history = counts[n - 2][shorter[some - 1]]
                prob = (count + prior * prob[shorter[some]]) / (history + prior)
            if n < own.order:
                self.fail += [0] * len(count) if n == 1 else (first[n - 2] + own.here[n - 2][some]).tolist()
                self.drop += np.log10(prior / (count + prior)).tolist()
            seen = np.flatnonzero(count > 0)
            if n == 1:
                seen = seen[own.tokens[some[seen]] != START]
            source = np.zeros(len(seen), np.int64) if n == 1 else first[n - 2] + own.here[n - 2][some[seen] - 1]
            target = first[n - 1] + seen if n < own.order else (first[n - 2] + own.here[n - 2][some[seen]] if n > 1 else np.zeros(len(seen), np.int64))
            self.arcs.update(zip((source * self.width + own.tokens[some[seen]]).tolist(), zip(np.log10(prob[seen]).tolist(), target.tolist())))
        head = own.here[own.order - 2][own.heads] if own.order > 1 else []
        self.initial = int(first[own.order - 2] + head[0]) if len(head) else 0

    def score(self, tokens: list[int]) -> float:
        """The log10 probability of a text's words and end."""
        state, total, arcs, fail, drop, width = self.initial, 0.0, self.arcs, self.fail, self.drop, self.width
        for word in tokens:
            while (arc := arcs.get(state * width + word)) is None:
                if not state:
                    arc = self.unknown, 0
                    break
                total += drop[state]
                state = fail[state]
            total += arc[0]
            state = arc[1]
        return total


def scored(order: int, prior: float, tokens: int, words: int, discount: float, kind: pa.DataType):
    def run(docs: pa.Table, sums: pa.Table) -> pa.Table:
        docs = docs.combine_chunks()
        own = Block(column(docs, "text"), column(docs, "learn").to_numpy(zero_copy_only=False), order)
        counts: list[list[np.ndarray]] = [[] for _ in range(order)]
        for r in sorted(sums.select(["n", "part", "short", "large"]).to_pylist(), key=lambda r: (r["n"], r["part"])):
            counts[r["n"] - 1].append(lengthened(r["short"], r["large"]))
        totals = [np.concatenate(c) for c in counts]
        machine = Automaton(own, totals, tokens, words, discount, prior)
        line, first = own.tokens[own.at].tolist(), own.starts.tolist()
        found = [machine.score(line[a:a + n]) for a, n in zip(first, own.lengths.tolist())]
        c = totals[0][own.here[0][own.at]]
        base = np.add.reduceat(np.log10((c + 0.1) / (tokens + 0.1 * (words + 1))), own.starts)
        known = np.add.reduceat((c > 0).astype(np.int64), own.starts)
        return pa.table([column(docs, "doc_id").cast(kind), pa.array(~column(docs, "learn").to_numpy(zero_copy_only=False)), pa.array(own.lengths), pa.array(known), pa.array([tokens] * len(line and first), pa.int64()),
                         pa.array(base), pa.array(found, pa.float64())], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
    return run


def score(docs: DataFrame, order: int = ORDER, prior: float = PRIOR) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row. Null and empty texts are one end
    token. Repeated rows are counted and scored as often as they occur. An empty table gives no rows."""
    size = text_bytes(docs)
    blocks, parts = parts_for(size, BLOCK_BYTES), parts_for(size, RANGE_BYTES)
    dealt = texts(docs).select("doc_id", "text", (fold(F.col("doc_id"), FOLDS) != HELD_OUT).alias("learn"), F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(blocks)).cast("int").alias("block"))
    start = int(Block(pa.array([""]), np.array([True]), max(order, 2)).start_key)
    sums = materialise(dealt.groupBy("block").applyInArrow(asked(parts, order), ASKED).groupBy("n", "part").applyInArrow(summed(start), SUMMED), "ngram_sums")
    tokens, words, once, twice = (x or 0 for x in sums.where("block < 0").agg(*(F.sum(c) for c in ("tokens", "words", "once", "twice"))).first())
    discount = once / (once + 2 * twice) if once and twice else 0.5
    id_type = docs.schema["doc_id"].dataType.simpleString()
    run = scored(order, prior, tokens, words, discount, to_arrow_type(docs.schema["doc_id"].dataType))
    return (dealt.groupBy("block").cogroup(sums.where("block >= 0").groupBy("block"))
            .applyInArrow(run, f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"))
