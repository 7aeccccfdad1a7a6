"""Spelling variants by finite-state composition.

The vocabulary is an acceptor A, the transducer E copies a word with exactly one inserted, deleted or replaced code point, and A o E o A accepts
the pairs of words that are one edit apart. A composed state is (p, edits so far, q). While nothing is edited both sides have read the
same letters, so p = q; the edit leads to some (p', 1, q'), and what follows is the common language of p' and q'. In the minimised
acceptor words that go on alike share their states: the language common to a pair of states is found once per pair, not once per word.

Partitions are paths from the initial state. Of two words one edit apart, the shorter `m` code points long, at least m // 2 code points
agree at the front or at the back. So each word goes, with the words of its own length and of one more, to the partition of its first m // 2
code points, and written backwards to that of its last ones; a partition has its own acceptor, and an edit is looked for only behind
its path. A partition's size depends on the alphabet and m, since its words differ in m // 2 + 2 places at most; whole partitions
are put together up to `TOGETHER` words for one acceptor.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import texts, utf8
from plumbline.session import materialise

LEAST_LENGTH, LEAST_COUNT, DROP_EVERY, TIMES = 5, 3, 97, 2
HELD_WORDS, HELD_BYTES = 200_000, 32 << 20
TOGETHER = 20_000
LATIN = 0xC3  # the first byte of U+00C0 to U+00FF in UTF-8; no other place of a text has it


def runs(text: bytes) -> list[bytes]:
    """Maximal runs of A-Z, a-z and U+00C0 to U+00FF, with A-Z lowered."""
    data = np.frombuffer(text.lower(), np.uint8)
    first = data == LATIN
    letter = ((data >= 0x61) & (data <= 0x7A)) | first
    letter[1:] |= first[:-1]
    return np.where(letter, data, 0x20).astype(np.uint8).tobytes().split()


def spelled(doc_id: str, text: bytes) -> list[bytes]:
    """The runs as the text is taken to spell them: where DROP_EVERY divides h, the checksum of "<doc_id>:<run>", the run loses its code
    point h % length."""
    found = runs(text)
    sums = np.fromiter(map(zlib.crc32, found, repeat(zlib.crc32(f"{doc_id}:".encode()))), np.int64, len(found))
    for i in np.flatnonzero(sums % DROP_EVERY == 0).tolist():
        run = found[i].decode()
        k = int(sums[i]) % len(run)
        found[i] = (run[:k] + run[k + 1:]).encode()
    return found


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id as text, text) to (word, n), summed over what a task holds at a time."""
    held: Counter[bytes] = Counter()

    def out() -> pa.RecordBatch:
        words = [(w, n) for w, n in zip(map(bytes.decode, held), held.values()) if len(w) >= LEAST_LENGTH]
        held.clear()
        return pa.record_batch([pa.array([w for w, _ in words], pa.string()), pa.array([n for _, n in words], pa.int64())], ["word", "n"])

    size = 0
    for batch in batches:
        ids = batch.column(0).to_pylist()
        data, offsets = utf8(batch.column(1))
        for i in range(batch.num_rows):
            held.update(spelled(ids[i] or "", data[offsets[i]:offsets[i + 1]].tobytes()))
            size += int(offsets[i + 1] - offsets[i])
            if len(held) > HELD_WORDS or size > HELD_BYTES:
                yield out()
                size = 0
    if held:
        yield out()


def vocabulary(docs: DataFrame, least: int = LEAST_COUNT) -> DataFrame:
    """word, n: the words of at least LEAST_LENGTH code points that occur at least `least` times in all texts together."""
    rows = texts(docs).select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return rows.mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


class Acceptor:
    """The minimal acyclic acceptor of sorted, distinct words. `arcs[q]` are (letter, state) in order, `final[q]` tells whether a word
    ends in q; `start` is the initial state."""

    def __init__(self, words: list[str]):
        known: dict[tuple, int] = {}
        self.arcs: list[tuple] = []
        self.final: list[bool] = []

        def close(final: bool, arcs: list) -> int:
            key = (final, *arcs)
            if (q := known.get(key)) is None:
                q = known[key] = len(self.arcs)
                self.arcs.append(key[1:])
                self.final.append(final)
            return q

        open_ends: list[tuple[bool, list]] = [(False, [])]  # the states on the path of the word before
        before = ""
        for word in [*words, ""]:
            same = 0
            while same < min(len(word), len(before)) and word[same] == before[same]:
                same += 1
            while len(open_ends) > same + 1:
                q = close(*open_ends.pop())
                open_ends[-1][1].append((before[len(open_ends) - 1], q))
            for i in range(same, len(word)):
                open_ends.append((i + 1 == len(word), []))
            before = word
        self.start = close(*open_ends.pop())

    def common(self, p: int, q: int) -> list[str]:
        """What both p and q accept, in any order."""
        found, todo = [], [(p, q, "")]
        while todo:
            a, b, read = todo.pop()
            if self.final[a] and self.final[b]:
                found.append(read)
            if a == b:
                todo += [(x, x, read + c) for c, x in self.arcs[a]]
            else:
                other = dict(self.arcs[b])
                todo += [(x, other[c], read + c) for c, x in self.arcs[a] if c in other]
        return found

    def edits(self, p: int) -> list[tuple[str, str]]:
        """The pairs of endings, one edit apart at their first letter, that p accepts: arcs of (p, 0, p) into (x, 1, y). A pair is given
        once: of two replaced letters the lesser first, and a missing letter is the first that differs."""
        found, arcs = [], self.arcs[p]
        for k, (a, x) in enumerate(arcs):
            for b, y in arcs[k + 1:]:
                found += [(a + end, b + end) for end in self.common(x, y)]
        for b, y in arcs:
            after = dict(self.arcs[y])
            if self.final[p] and self.final[y]:
                found.append(("", b))
            found += [(c + end, b + c + end) for c, x in arcs if c != b and c in after for end in self.common(x, after[c])]
        return found

    def pairs(self, behind: int) -> Iterator[tuple[str, str]]:
        """The accepted pairs whose edit comes after the first `behind` letters."""
        edits: dict[int, list[tuple[str, str]]] = {}
        todo = [(self.start, "")]
        while todo:
            p, read = todo.pop()
            if len(read) >= behind:
                if p not in edits:
                    edits[p] = self.edits(p)
                for u, v in edits[p]:
                    yield read + u, read + v
            todo += [(q, read + c) for c, q in self.arcs[p]]


def composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (back, m, path, word, n), sorted, of whole partitions, to (word, near words, best count, best word) per word and acceptor."""
    def found(back: bool, m: int, counts: dict[str, int]) -> Iterator[pa.RecordBatch]:
        best: dict[str, tuple[int, int, str]] = {}
        behind = m // 2
        turned = (lambda w: w[::-1]) if back else (lambda w: w)

        def note(word: str, near: str) -> None:
            seen, n, held = best.get(word, (0, 0, ""))
            k = counts[near]
            best[word] = (seen + 1, k, near) if k > n or k == n and near < held else (seen + 1, n, held)

        for u, v in Acceptor(sorted(map(turned, counts))).pairs(behind):
            u, v = turned(u), turned(v)
            if min(len(u), len(v)) != m or back and u[:behind] == v[:behind]:  # the other class, or the forward partition has it
                continue
            note(u, v)
            note(v, u)
        if best:
            yield pa.record_batch([pa.array(list(best)), pa.array([b[0] for b in best.values()], pa.int64()), pa.array([b[1] for b in best.values()], pa.int64()), pa.array([b[2] for b in best.values()])],
                                  ["word", "n_near", "best_n", "best"])

    group, path, held = None, None, {}
    for batch in batches:
        for back, m, at, word, n in zip(*(c.to_pylist() for c in batch.columns)):
            if group is not None and ((back, m) != group or at != path and len(held) > TOGETHER):
                yield from found(*group, held)
                held = {}
            group, path = (back, m), at
            held[word] = n
    if group is not None:
        yield from found(*group, held)


def neighbours(words: DataFrame) -> DataFrame:
    """word, n_near, best_n, best for the words of `words` (word, n) with at least one word one edit away: how many there are, and the one
    of largest n (ties: smallest in code-point order)."""
    length = F.char_length("word")
    places = [F.struct(F.lit(back).alias("back"), (length - less).cast("int").alias("m"),
                       F.substring(F.reverse("word") if back else F.col("word"), F.lit(1), F.floor((length - less) / 2).cast("int")).alias("path"))
              for back in (False, True) for less in (0, 1)]
    dealt = words.select("word", "n", F.explode(F.array(*places)).alias("at")).where(F.col("at.m") >= LEAST_LENGTH).select("at.back", "at.m", "at.path", "word", "n")
    spread = dealt.repartition("back", "m", "path").sortWithinPartitions("back", "m", "path")
    found = spread.mapInArrow(composed, "word string, n_near long, best_n long, best string")
    return (found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("less"), "best")).alias("top"))
            .select("word", "n_near", (-F.col("top.less")).alias("best_n"), F.col("top.best").alias("best")))


def rooted(forms: DataFrame) -> DataFrame:
    """`forms` (word, form, ...) with `root`: where following forms ends. Every step doubles how far a word has followed; counts at least double
    along forms, so a few steps do, each a written table."""
    now = materialise(forms.select("word", F.coalesce("form", "word").alias("root")).where("word <> root"), "roots")
    while now.join(now.select(F.col("word").alias("_w")), F.col("root") == F.col("_w"), "left_semi").head() is not None:
        on = now.select(F.col("word").alias("_w"), F.col("root").alias("_r"))
        now = materialise(now.join(on, F.col("root") == F.col("_w"), "left").select("word", F.coalesce("_r", "root").alias("root")), "roots")
    return forms.join(now, "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(docs: DataFrame, least: int = LEAST_COUNT, times: int = TIMES) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of the vocabulary. `form` is the near word of largest n, if that is at least
    `times` the word's own.

    Null and empty texts have no words; a null doc_id is written as nothing in the checksum. Repeated rows count as often as they
    occur, ties go to the smallest word in code-point order. Other columns are left out, whatever their names; an empty table
    gives no rows."""
    words = materialise(vocabulary(docs, least), "vocabulary")
    near = words.join(neighbours(words), "word", "left")
    enough = F.col("best_n") >= times * F.col("n")
    forms = near.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(enough, F.col("best")).alias("form"), F.when(enough, F.col("best_n")).alias("form_n"))
    return rooted(materialise(forms, "forms")).select("word", "form", "root", "n", "n_near", "form_n")
