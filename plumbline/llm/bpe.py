"""Byte-pair encoding by forced boundaries, and decoding.

A merge only ever makes a token of the vocabulary. Where two neighbouring bytes never stand side by side inside any token, no
merge can reach across: the place is a certain cut, and the two sides encode on their own. The fragments are short and repeat,
so each distinct one is encoded once per worker process, as long as its bounded memo holds it, and looked up afterwards.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from plumbline.llm.common import once_per_worker, slices, texts, utf8

CHUNK_BYTES = 1 << 20
FRAGMENTS_AT_ONCE = 200_000
MEMO_ENTRIES, MEMO_BYTES = 400_000, 24 << 20
WHITE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 28, 29, 30, 31, 32])
APOSTROPHE = 0x27


class Distinct:
    """Which of many byte strings are equal: two rolling hashes (sums of byte values times powers of an odd base, modulo 2^64) of every
    string at once; equal strings have equal first hashes, and the second one confirms it."""

    BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)

    def __init__(self) -> None:
        self.values = [np.random.default_rng(7 + i).integers(0, 1 << 64, 256, np.uint64) for i in (0, 1)]
        self.powers = [np.ones(1, np.uint64)] * 2
        self.inverse = [np.ones(1, np.uint64)] * 2

    def _up_to(self, n: int) -> None:
        if len(self.powers[0]) < n:
            run = lambda base: np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, base, np.uint64))])
            self.powers = [run(b) for b in self.BASES]
            self.inverse = [run(pow(b, -1, 1 << 64)) for b in self.BASES]

    def of(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """An index of each different string, and for every string which of these it is."""
        size = 1 << int(len(data)).bit_length()
        self._up_to(size)
        found = []
        for value, power, inverse in zip(self.values, self.powers, self.inverse):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value[data] * power[:len(data)], dtype=np.uint64)])
            found.append((total[ends] - total[starts]) * inverse[starts])
        _, first, which = np.unique(found[0], return_index=True, return_inverse=True)
        if (found[1] != found[1][first][which]).any():  # strings that differ share the first hash
            _, first, which = np.unique(np.rec.fromarrays(found), return_index=True, return_inverse=True)
        return first, which


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable bytes for themselves, the others in
    order from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Decoder:
    """The bytes of each id of a tokenizer file of the `tokenizers` library (byte-level BPE); `special` are the added tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            read = json.load(file)
        latin = {ord(c): chr(b) for c, b in byte_alphabet().items()}
        self.special = {t["content"].encode(): t["id"] for t in read["added_tokens"]}
        plain = {i: t for t, i in read["model"]["vocab"].items()}
        self.token = [b""] * (max([*plain, *self.special.values()]) + 1)
        for i, raw in zip(plain, "\n".join(plain.values()).translate(latin | {10: "\u0100"}).split("\u0100")):
            self.token[i] = raw.encode("latin-1")
        for t, i in self.special.items():
            self.token[i] = t

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become the replacement character, unknown ids nothing."""
        known = len(self.token)
        return b"".join([self.token[i] for i in ids if 0 <= i < known]).decode("utf-8", "replace")


class Codec(Decoder):
    """Encoder and decoder of one tokenizer file (without a normaliser). Ids are those of
    ``Tokenizer.encode(text, add_special_tokens=False)``; a special token's string becomes its id, as there."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__(path)
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        inside = np.zeros((256, 256), bool)
        plain = set(range(len(self.token))) - set(self.special.values())
        line = np.frombuffer(b"".join(self.token[i] for i in plain), np.uint8)
        ends = np.cumsum(np.fromiter((len(self.token[i]) for i in plain), np.int64, len(plain))) - 1
        follows = np.ones(max(len(line) - 1, 0), bool)
        follows[ends[ends < len(follows)]] = False
        inside[line[:-1][follows], line[1:][follows]] = True
        self.apart = ~inside
        self.merged = self._merged(path)
        self.distinct = Distinct()
        self.memo: dict[bytes, int] = {}
        self.memo_bytes = 0
        self.first, self.count, self.flat = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)
        self.hits = np.empty(0, np.int64)

    def forget(self) -> None:
        """Keeps the fragments met more than twice since the last time, unless those are most of them."""
        keep = np.flatnonzero(self.hits > 2)
        if 2 * len(keep) > len(self.hits):
            keep = keep[:0]
        n = self.count[keep]
        self.flat = self.flat[np.repeat(self.first[keep] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        self.first, self.count, self.hits = np.cumsum(n) - n, n, np.zeros(len(keep), np.int64)
        names = list(self.memo)  # in the order of their numbers
        self.memo = {names[k]: i for i, k in enumerate(keep.tolist())}
        self.memo_bytes = sum(map(len, self.memo)) + 4 * len(self.flat)

    def cuts(self, data: np.ndarray) -> np.ndarray:
        """Whether a fragment starts at each byte: the certain cuts at which splitting into words can't differ either,
        which rules out a place behind white space (the splitter looks ahead there) and around an apostrophe (it starts
        contractions)."""
        start = np.ones(len(data), bool)
        left, right = data[:-1], data[1:]
        before = np.concatenate([[0], data[:-2]])[:len(left)]
        whole = (left < 0x80) | ((left & 0xC0) == 0x80) & (before >= 0xC3) & (before < 0xE0)  # ASCII or a two-byte letter or mark ends here
        start[1:] = self.apart[left, right] & whole & ~WHITE[left] & ((right & 0xC0) != 0x80) & (left != APOSTROPHE) & (right != APOSTROPHE)
        return start

    def _merged(self, path: str):
        """bytes -> ids of one word, by merging the pair that makes the token of lowest id; None where that can differ from the file's
        merges. It can't where every merge makes the next id: a token's bytes then have one way to come about, and
        what is merged inside a token's bytes does not depend on what stands around them."""
        import tiktoken

        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        made = [model["vocab"].get("".join(m.split(" ") if isinstance(m, str) else m), -1) for m in model["merges"]]
        if made != list(range(256, 256 + len(made))) or model.get("ignore_merges") or model.get("dropout"):
            return None
        ranks = {self.token[i]: i for i in range(256 + len(made))}
        return tiktoken.Encoding("own", pat_str=r"\p{L}+", mergeable_ranks=ranks, special_tokens={})._encode_single_piece if len(ranks) == 256 + len(made) else None

    def _encoded(self, fragments: list[bytes]) -> list[list[int]]:
        """Ids of each fragment. Letters with at most one space before them are one word to the splitter and are merged right away."""
        out: list[list[int]] = [[]] * len(fragments)
        alone = []
        for i, f in enumerate(fragments):
            if self.merged and (f[1:] if f[:1] == b" " else f).decode().isalpha():
                out[i] = self.merged(f)
            else:
                alone.append(i)
        for i, e in zip(alone, self.tokenizer.encode_batch_fast([fragments[i].decode() for i in alone], add_special_tokens=False)):
            out[i] = e.ids
        return out

    def learn(self, new: list[bytes]) -> None:
        got = self._encoded(new)
        lengths = np.fromiter(map(len, got), np.int64, len(got))
        at = len(self.flat)
        self.first = np.concatenate([self.first, at + np.cumsum(lengths) - lengths])
        self.count = np.concatenate([self.count, lengths])
        self.hits = np.concatenate([self.hits, np.zeros(len(new), np.int64)])
        self.flat = np.concatenate([self.flat, np.fromiter((i for ids in got for i in ids), np.int32, int(lengths.sum()))])
        self.memo.update(zip(new, range(len(self.memo), len(self.memo) + len(new))))
        self.memo_bytes += sum(map(len, new)) + 4 * int(lengths.sum())

    def look_up(self, fragments: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.memo.get, fragments, repeat(-1)), np.int64, len(fragments))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text's ids start (one more entry than texts)."""
        raw = data.tobytes()
        start = self.cuts(data)
        start[offsets[:-1][offsets[:-1] < len(data)]] = True
        starts = np.flatnonzero(start)
        fixed: dict[int, int] = {}  # fragments that are special tokens
        if any(t in raw for t in self.special):
            starts = self._around_special(raw, starts, offsets, fixed)
        ends = np.concatenate([starts[1:], [len(data)]])
        ids, counts = [], []
        for a in range(0, len(starts), FRAGMENTS_AT_ONCE):
            if len(self.memo) > MEMO_ENTRIES or self.memo_bytes > MEMO_BYTES:
                self.forget()
            some = slice(a, a + FRAGMENTS_AT_ONCE)
            first, last = int(starts[a]), int(ends[some][-1])
            here = [k for k in range(a, min(a + FRAGMENTS_AT_ONCE, len(starts))) if k in fixed] if fixed else []
            begin, end = starts[some] - first, ends[some] - first
            end[[k - a for k in here]] = begin[[k - a for k in here]]  # their ids are put in below
            each, which = self.distinct.of(data[first:last], begin, end)
            fragments = [raw[first + i:first + j] for i, j in zip(begin[each].tolist(), end[each].tolist())]
            known = self.look_up(fragments)
            if len(unknown := np.flatnonzero(known < 0)):
                new = [fragments[k] for k in unknown.tolist()]
                self.learn(new)
                known[unknown] = self.look_up(new)
            found = known[which]
            self.hits += np.bincount(found, minlength=len(self.hits))
            n = self.count[found]
            shift = np.repeat(self.first[found] - (np.cumsum(n) - n), n)
            out = self.flat[shift + np.arange(len(shift))]
            if here:
                out = np.insert(out, (np.cumsum(n) - n)[[k - a for k in here]], [fixed[k] for k in here])
                n[[k - a for k in here]] = 1
            ids.append(out)
            counts.append(n)
        tokens = np.concatenate([[0], np.cumsum(np.concatenate([*counts, np.empty(0, np.int64)]))])
        return np.concatenate([*ids, np.empty(0, np.int32)]), tokens[np.searchsorted(starts, offsets)]

    def _around_special(self, raw: bytes, starts: np.ndarray, offsets: np.ndarray, fixed: dict[int, int]) -> np.ndarray:
        """The starts with every special token's string as a fragment of its own; `fixed` gets fragment number -> id."""
        spans, at, bounds = [], 0, offsets.tolist()
        while found := [(i, -len(t), t) for t in self.special if (i := raw.find(t, at)) >= 0]:
            i, _, t = min(found)
            inside = np.searchsorted(offsets, i, "right") == np.searchsorted(offsets, i + len(t) - 1, "right")
            if inside:
                spans.append((i, i + len(t), self.special[t]))
            at = i + (len(t) if inside else 1)
        keep = np.ones(len(starts), bool)
        for i, j, _ in spans:
            keep &= ~((starts > i) & (starts < j))
        edges = [x for i, j, _ in spans for x in (i, j) if x < bounds[-1]]
        starts = np.union1d(starts[keep], np.array(edges, np.int64))
        fixed.update((int(np.searchsorted(starts, i)), number) for i, _, number in spans)
        return starts


def codec(path: str) -> Codec:
    """One codec per worker process, with its memo."""
    return once_per_worker(f"codec {path}", lambda: Codec(path))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array<int>): the ids of each whole text. Null and empty texts have no ids; every row comes back once,
    repeated rows too, an empty table gives none; other columns are left out, whatever their names. `path` is a tokenizer file that the executors can read."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for a, b in slices(offsets, CHUNK_BYTES):
                ids, starts = own.encode(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
                yield pa.record_batch([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids, pa.int32()))], ["doc_id", "ids"])

    return texts(docs).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """The rows of `tokens` (doc_id, ids) with `text`, the decoded ids. Null ids give null, no ids the empty text; other columns are left
    out, repeated rows each come back, an empty table gives no rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = once_per_worker(f"decoder {path}", lambda: Decoder(path))
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                lists = part.column(1)
                at, gone = lists.offsets.to_numpy(), lists.is_null().to_pylist()
                ids = lists.values.slice(at[0], at[-1] - at[0]).fill_null(-1).to_numpy().tolist()
                decoded = [None if none else own.decode(ids[i:j]) for none, i, j in zip(gone, (at[:-1] - at[0]).tolist(), (at[1:] - at[0]).tolist())]
                yield pa.record_batch([part.column(0), lists, pa.array(decoded, pa.string())], ["doc_id", "ids", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(run, f"doc_id {tokens.schema['doc_id'].dataType.simpleString()}, ids array<int>, text string")
