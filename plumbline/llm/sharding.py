"""Sharding by best-fit-decreasing bin packing: whole groups of equal texts, largest first, enter the shard with the least capacity
left that still holds them, found in a balanced tree; the capacity is the smallest at which the wanted number of shards is enough.

Groups that are small beside a shard are first put together, by the hash of their key, into parcels, which are then the indivisible
items; larger groups are items of their own, and only those that no shard can hold are cut. So there are at most `parcels` + a few
thousand items, whatever the input.
"""

from __future__ import annotations

import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import bucket, numbered
from plumbline.session import materialise

SHARDS, PARCELS_PER_SHARD = 40, 256
ROW_BYTES = 16


class Treap:
    """An ordered set of (capacity left, shard), balanced by random priorities."""

    def __init__(self) -> None:
        self.root, self.random = None, random.Random(7)

    def _merge(self, a: list | None, b: list | None) -> list | None:
        if a is None or b is None:
            return a or b
        if a[1] < b[1]:
            a[3] = self._merge(a[3], b)
            return a
        b[2] = self._merge(a, b[2])
        return b

    def _split(self, node: list | None, key: tuple[int, int]) -> tuple[list | None, list | None]:
        """Below `key`, and the rest."""
        if node is None:
            return None, None
        if node[0] < key:
            node[3], rest = self._split(node[3], key)
            return node, rest
        below, node[2] = self._split(node[2], key)
        return below, node

    def add(self, key: tuple[int, int]) -> None:
        below, rest = self._split(self.root, key)
        self.root = self._merge(self._merge(below, [key, self.random.random(), None, None]), rest)

    def take(self, key: tuple[int, int]) -> tuple[int, int] | None:
        """The least entry from `key` on, which leaves the set; None if there is none."""
        below, rest = self._split(self.root, key)
        if rest is None:
            self.root = below
            return None
        least = rest
        while least[2] is not None:
            least = least[2]
        _, rest = self._split(rest, (least[0][0], least[0][1] + 1))
        self.root = self._merge(below, rest)
        return least[0]


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """The shard of each item; a shard is opened only when no open one has room."""
    shards, free, out = 0, Treap(), [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        found = free.take((sizes[i], -1))
        left, shard = found or (capacity, shards)
        shards += found is None
        out[i] = shard
        free.add((left - sizes[i], shard))
    return out


def fewest(sizes: list[int], shards: int) -> list[int]:
    """Best-fit-decreasing at the smallest capacity, to a thousandth of a percent, that needs at most `shards` shards."""
    total, largest = sum(sizes), max(sizes, default=0)
    low = max(-(-total // shards), largest)
    high, step = low, max(1, low // 100_000)
    while max(best := best_fit_decreasing(sizes, high), default=0) >= shards:
        high += max(step, high // 200)
    while high - low > step:
        middle = (low + high) // 2
        got = best_fit_decreasing(sizes, middle)
        if max(got, default=0) < shards:
            high, best = middle, got
        else:
            low = middle
    return best


def shard(docs: DataFrame, shards: int = SHARDS, parcels: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard (from 0), slot (from 0 in its shard, without holes): shards of near equal bytes.

    Rows of equal texts stay in one shard unless they are more bytes than a shard's even share: such a group is cut by doc_id into
    chunks of a 64th of it. A null text counts as empty. Repeated rows each get a slot. An empty table gives no rows."""
    parcels = parcels or shards * PARCELS_PER_SHARD
    text = F.coalesce(docs["text"], F.lit(""))
    rows = materialise(docs.select("doc_id", (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("_key")), "rows")
    total, n = rows.agg(F.sum("size"), F.count(F.lit(1))).first()
    whole, part = -(-(total or 0) // shards), max(1, (total or 0) // (shards * 64))
    large = (rows.groupBy("_key").agg(F.sum("size").alias("_group")).where(F.col("_group") > part)  # fewer than shards * 64 rows
             .select("_key", F.when(F.col("_group") > whole, F.ceil(F.col("_group") / part)).otherwise(1).alias("_chunks")))
    parcel = F.concat(F.lit("p"), bucket(["_key"], parcels).cast("string"))
    chunk = F.concat_ws(":", F.hex("_key"), F.pmod(F.xxhash64("doc_id", F.lit("chunk")), F.col("_chunks")).cast("string"))
    items = rows.join(F.broadcast(large), "_key", "left").withColumn("_item", F.when(F.col("_chunks").isNull(), parcel).otherwise(chunk)).drop("_chunks")
    sizes = items.groupBy("_item").agg(F.sum("size").alias("n")).collect()  # at most parcels + 2 * 64 * shards rows
    sizes.sort(key=lambda r: r["_item"])
    where = docs.sparkSession.createDataFrame([(r["_item"], s) for r, s in zip(sizes, fewest([r["n"] for r in sizes], shards))], "_item string, shard int")
    placed = materialise(items.join(F.broadcast(where), "_item").drop("_item", "_key"), "placed")
    return numbered(placed, ["shard"], ["doc_id", "text_crc32", "size"], n, "slot")
