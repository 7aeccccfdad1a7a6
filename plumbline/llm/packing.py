"""Best-fit packing of token pieces into sequences, with exact complements first.

The plan is made on the number of pieces of each length, at most `capacity` numbers whatever the input: for the longest length
left, one, two or three other lengths that fill its gap exactly are looked up among the lengths still available and taken as often
as the counts allow; what has no exact filling goes into the tightest gap (best fit, longest first). The plan is a short table of
runs (length, range of positions within the length -> sequences), which is joined to the numbered pieces.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.bpe import CHUNK_BYTES, codec
from plumbline.llm.common import numbered, slices, texts, utf8
from plumbline.session import materialise

CAPACITY, END_ID = 2048, 0


class Run(NamedTuple):
    """Pieces `first` .. `first + pieces - 1` of a length: `together` of them side by side in each sequence."""
    length: int
    first: int
    pieces: int
    together: int
    sequence: int
    offset: int


class Planner:
    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity, self.left, self.used = capacity, [0] * (capacity + 1), Counter()
        self.runs: list[Run] = []
        self.sequences = 0
        self.present = self.mirror = 0  # bit l, and bit capacity - l: length l is available
        for length, n in counts.items():
            self._set(length, n)

    def _set(self, length: int, n: int) -> None:
        self.left[length] = n
        bit, back = 1 << length, 1 << (self.capacity - length)
        self.present, self.mirror = (self.present | bit, self.mirror | back) if n else (self.present & ~bit, self.mirror & ~back)

    def _pair(self, total: int) -> tuple[int, int] | None:
        """Two available lengths of this sum, the longer as long as can be."""
        both = self.present & (self.mirror >> (self.capacity - total)) & ~1
        longer = both.bit_length() - 1
        if longer < 1 or 2 * longer == total and self.left[longer] < 2:
            return None
        return longer, total - longer

    def _filling(self, gap: int) -> tuple[int, ...] | None:
        """One, two or three available lengths that add up to `gap`."""
        if gap and self.left[gap]:
            return (gap,)
        if pair := self._pair(gap):
            return pair
        rest = self.present & ((1 << gap) - 1) & ~1
        while rest:
            x = rest.bit_length() - 1
            rest ^= 1 << x
            n = self.left[x]
            self._set(x, n - 1)
            pair = self._pair(gap - x)
            self._set(x, n)
            if pair:
                return x, *pair
        return None

    def _put(self, length: int, together: int, copies: int, sequence: int, offset: int) -> None:
        self.runs.append(Run(length, self.used[length], together * copies, together, sequence, offset))
        self.used[length] += together * copies
        self._set(length, self.left[length] - together * copies)

    def exact(self, longest: int) -> None:
        while self.left[longest]:
            n = self.left[longest]
            self._set(longest, n - 1)
            filling = () if longest == self.capacity else self._filling(self.capacity - longest)
            self._set(longest, n)
            if filling is None:
                return
            need = Counter((longest, *filling))
            copies, offset = min(self.left[x] // k for x, k in need.items()), 0
            for x, k in need.items():
                self._put(x, k, copies, self.sequences, offset)
                offset += x * k
            self.sequences += copies

    def best_fit(self) -> None:
        gaps: dict[int, list[tuple[int, int, int]]] = {}  # gap -> (first sequence, sequences, filled)
        open_gaps = 0

        def leave(gap: int, entry: tuple[int, int, int]) -> None:
            nonlocal open_gaps
            if gap and entry[1]:
                gaps.setdefault(gap, []).append(entry)
                open_gaps |= 1 << gap

        for length in range(self.capacity, 0, -1):
            while n := self.left[length]:
                if wide := open_gaps >> length:
                    gap = length + (wide & -wide).bit_length() - 1
                    sequence, copies, filled = gaps[gap].pop()
                    if not gaps[gap]:
                        open_gaps &= ~(1 << gap)
                    here = min(n, copies)
                    leave(gap, (sequence + here, copies - here, filled))
                    self._put(length, 1, here, sequence, filled)
                    leave(gap - length, (sequence, here, filled + length))
                else:
                    together = min(n, self.capacity // length)
                    copies = n // together
                    self._put(length, together, copies, self.sequences, 0)
                    leave(self.capacity - together * length, (self.sequences, copies, together * length))
                    self.sequences += copies


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Run]:
    """Runs for so many pieces of each length from 1 to `capacity`. Their number depends on `capacity` only: each step
    uses up a length or an open gap."""
    planner = Planner(counts, capacity)
    for longest in range(capacity, 0, -1):
        planner.exact(longest)
    planner.best_fit()
    return planner.runs


def cut(ids: np.ndarray, capacity: int) -> Iterator[tuple[int, int]]:
    """Start and end of a document's pieces: only the first may be shorter."""
    end = (len(ids) - 1) % capacity + 1
    yield 0, end
    for start in range(end, len(ids), capacity):
        yield start, start + capacity


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids: each whole text's tokens and `end_id` behind them, cut
    into pieces of `capacity` where they are longer. A null or empty text is one piece that holds `end_id`."""
    fields = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_codec, end = codec(path), np.array([end_id], "<u4")
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for a, b in slices(offsets, CHUNK_BYTES):
                ids, starts = own_codec.encode(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
                rows: list[tuple] = []
                for k, row in enumerate(range(a, b)):
                    own = np.concatenate([ids[starts[k]:starts[k + 1]].astype("<u4"), end])
                    rows += [(row, n, i, j - i, zlib.crc32(own[i:j].tobytes()), *[own[i:j].astype(np.int32)] * with_ids) for n, (i, j) in enumerate(cut(own, capacity))]
                columns = list(zip(*rows))
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
                yield pa.record_batch([batch.column(0).take(pa.array(columns[0], pa.int64())), *[pa.array(c, t) for c, t in zip(columns[1:], kinds)]], fields)

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return texts(docs).mapInArrow(run, schema)


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """The pieces of `docs` with sequence_id and offset. Sequences hold at most `capacity` tokens, without gaps. Repeated rows
    are packed as often as they occur, rows with equal ids, pieces and texts in any order; an empty table gives no rows."""
    cut_up = materialise(pieces(docs, path, capacity, end_id, with_ids), "pieces")
    counts = {r["length"]: r["n"] for r in cut_up.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    runs = docs.sparkSession.createDataFrame(plan(counts, capacity), "_length long, _first long, _pieces long, _together long, _sequence long, _offset long")
    order = ["doc_id", "piece", "start", "ids_crc32"]
    ranked = numbered(cut_up, ["length"], order, sum(counts.values()), "_rank")
    rank = F.col("_rank") - F.col("_first")
    placed = ranked.join(F.broadcast(runs), (F.col("length") == F.col("_length")) & (rank >= 0) & (rank < F.col("_pieces")))  # see plan(): bounded by `capacity`
    return (placed.withColumn("sequence_id", F.col("_sequence") + F.floor(rank / F.col("_together")))
            .withColumn("offset", F.col("_offset") + rank % F.col("_together") * F.col("length"))
            .select(*cut_up.columns, "sequence_id", "offset"))
