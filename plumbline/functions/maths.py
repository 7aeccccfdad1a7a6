"""Probability columns over in-row arrays: no shuffle, one row per item."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.binding import let

ROUND = 4


def total(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda a, x: a + x)


def normalised(arr: Column) -> Column:
    return let(arr, lambda a: let(total(a), lambda z: F.transform(a, lambda x: x / z)))


def softmax(logits: Column, temperature: float | Column = 1.0) -> Column:
    t = F.lit(float(temperature)) if isinstance(temperature, (int, float)) else temperature
    return normalised(let(logits, lambda a: let(F.array_max(a), lambda top: F.transform(
        a, lambda x: F.exp((x - top) / t)))))


def confidence(probs: Column) -> Column:
    """1 - entropy / ln(n), clipped at 0 and rounded; 1 for a single option."""
    entropy = F.aggregate(probs, F.lit(0.0), lambda a, p: a + F.when(p > 0, -p * F.log(p)).otherwise(F.lit(0.0)))
    n = F.size(probs)
    return F.when(n > 1, F.round(F.greatest(F.lit(0.0), 1 - entropy / F.log(n.cast("double"))), ROUND)
                  ).otherwise(F.lit(1.0))


def first_top(probs: Column) -> Column:
    """1-based position of the largest value; the first one wins a tie."""
    return F.array_position(probs, F.array_max(probs)).cast("int")


def expected_level(probs: Column) -> Column:
    return F.aggregate(F.arrays_zip(F.sequence(F.lit(0), F.size(probs) - 1).alias("i"), probs.alias("p")), F.lit(0.0),
                       lambda a, s: a + s["i"].cast("double") * s["p"])


def letter_probs(seen: Column, letters: Column, temperature: float = 1.0) -> Column:
    """Option probabilities from `seen` (map of trimmed token to summed probability) for the array `letters`. A letter
    that was not seen gets half the smallest seen probability."""
    def floored(m: Column) -> Column:
        return F.coalesce(F.array_min(F.map_values(m)), F.lit(1e-6)) * 0.5

    return normalised(let(seen, lambda m: let(floored(m), lambda floor: F.transform(
        letters, lambda l: F.pow(F.coalesce(m[l], floor), F.lit(1.0 / temperature))))))


def token_mass(tokens: Column) -> Column:
    """Map of trimmed token to summed probability, from an array of (token, logprob)."""
    trimmed = F.transform(tokens, lambda t: F.struct(F.regexp_replace(t["token"], r"(?U)^\s+|\s+$", "").alias("token"),
                                                     F.exp(t["logprob"]).alias("p")))
    return let(trimmed, lambda x: F.map_from_entries(F.transform(
        F.array_distinct(F.transform(x, lambda t: t["token"])), lambda n: F.struct(n, F.aggregate(
            x, F.lit(0.0), lambda a, t: a + F.when(t["token"] == n, t["p"]).otherwise(F.lit(0.0)))))))


def soft_target(gold_pos: Column, teacher: Column, alpha: float, teacher_temperature: float = 1.0) -> Column:
    """Target distribution: (1 - alpha) on the gold option plus alpha times the sharpened teacher distribution
    (floored at 1e-6). Without a teacher (null or empty array) the gold option gets everything."""
    sharp = F.transform(teacher, lambda p: F.pow(F.greatest(p, F.lit(1e-6)), F.lit(1.0 / teacher_temperature)))
    share = normalised(sharp)
    mixed = F.transform(share, lambda p, i: p * alpha + F.when(i + 1 == gold_pos, F.lit(1.0 - alpha))
                        .otherwise(F.lit(0.0)))
    return normalised(mixed)


def hard_target(gold_pos: Column, n: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.when(i == gold_pos, F.lit(1.0)).otherwise(F.lit(0.0)))


def is_soft(probs: Column) -> Column:
    return F.array_max(probs) < 0.999


def keep_keys(probs: Column, keys: Column) -> Column:
    """The map restricted to `keys` and renormalised; a zero total counts as one."""
    kept = let(keys, lambda ks: F.map_filter(probs, lambda k, v: F.array_contains(ks, k)))
    return let(kept, lambda m: let(total(F.map_values(m)), lambda z: F.transform_values(
        m, lambda k, v: v / F.when(z == 0, F.lit(1.0)).otherwise(z))))


def bin10(p: Column, bins: int = 10) -> Column:
    """Bin index for the bins (0, 1/n], (1/n, 2/n], ...; p = 0 belongs to the first. Comparing with each edge keeps
    values that sit exactly on an edge in the lower bin, which multiplying by n would not."""
    out = F.lit(0)
    for b in range(1, bins):
        out = out + (p > F.lit(b / bins)).cast("int")
    return out


def nll(p: Column) -> Column:
    return -F.log(F.greatest(p, F.lit(1e-9)))
