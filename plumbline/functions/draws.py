"""Draws that depend only on (seed, id): the same row gets the same draw in any partitioning, run or engine.

MD5 is used because every SQL engine has it, so a sample can be checked outside Spark.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNIT_DIGITS = 13  # 13 hex digits = 52 bits, exact in a double


def unit(seed: int | str, *ids: Column, salt: str = "") -> Column:
    """A number in [0, 1) for the row identified by `ids`."""
    text = F.concat_ws(":", F.lit(str(seed)), F.lit(salt), *[i.cast("string") for i in ids])
    return F.conv(F.substring(F.md5(text), 1, UNIT_DIGITS), 16, 10).cast("double") / F.lit(float(16 ** UNIT_DIGITS))


def rank_key(seed: int | str, *ids: Column, salt: str = "") -> Column:
    """A string whose order is a seeded shuffle of the rows. Ties are impossible for distinct ids in practice."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(salt), *[i.cast("string") for i in ids]))


def pick_index(seed: int | str, n: Column | int, *ids: Column, salt: str = "") -> Column:
    """A 0-based index below `n`."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.floor(unit(seed, *ids, salt=salt) * n).cast("int")


def hash_bucket(text: Column, buckets: int = 100) -> Column:
    """SHA-1 of the text, read as one 160-bit number, modulo `buckets`. Taken in four 40-bit pieces, because the whole
    number does not fit a BIGINT."""
    step = (16 ** 10) % buckets
    digest = F.sha1(text)
    out = F.lit(0).cast("bigint")
    for i in range(4):
        piece = F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 10).cast("bigint")
        out = (out * step + piece) % buckets
    return out.cast("int")


def split_of(tid: Column, val_percent: int = 5) -> Column:
    """'val' for about `val_percent` of ids, else 'train'. All rows that share `tid` land on the same side."""
    return F.when(hash_bucket(tid) < val_percent, F.lit("val")).otherwise(F.lit("train"))


def weighted_choice(u: Column, names: list[str], weights: list[float]) -> Column:
    """Pick one of `names` by weight with the draw `u`. The list is a parameter, so this stays a short expression."""
    total, running, out = float(sum(weights)), 0.0, None
    for name, weight in zip(names, weights):
        running += weight
        test = u < F.lit(running / total)
        out = F.when(test, F.lit(name)) if out is None else out.when(test, F.lit(name))
    return out.otherwise(F.lit(names[-1]))


def shuffle_array(arr: Column, seed: int | str, row_id: Column, element_id) -> Column:
    """The array in a seeded order; `element_id` maps an element to the column that identifies it."""
    keyed = F.transform(arr, lambda e: F.struct(rank_key(seed, row_id, element_id(e)).alias("k"), e.alias("e")))
    return F.transform(F.array_sort(keyed, lambda a, b: F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1)
                                    .otherwise(0)), lambda s: s["e"])
