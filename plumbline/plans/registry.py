"""Named queries over the driver's tables, each with the SQL that has to give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.sources.tables import load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The tables of one scale factor: `t.orders` is a DataFrame."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return load(self.spark, self.folder, name)


def query(name: str, sql: str | None = None):
    """Register a function of `Tables` under a name, with its SQL twin when SQL can say it."""
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


# ---- SQL fragments shared by the twins --------------------------------------------------------------------------------

def sql_words(col: str) -> str:
    return rf"regexp_extract_all(lower({col}), '[\p{{L}}\p{{N}}_]+')"


def sql_shingles(words: str, n: int) -> str:
    return f"list_transform(range(1, len({words}) - {n - 2}), lambda i: array_to_string({words}[i:i+{n - 1}], ' '))"


def sql_unit(*parts: str, seed: str = "0", salt: str = "") -> str:
    text = " || ':' || ".join([f"'{seed}'", f"'{salt}'", *[f"CAST({p} AS VARCHAR)" for p in parts]])
    return f"(CAST(('0x' || substr(md5({text}), 1, 13)) AS BIGINT) / 4503599627370496.0)"


def sql_key(*parts: str, seed: str = "0", salt: str = "") -> str:
    return "md5(" + " || ':' || ".join([f"'{seed}'", f"'{salt}'", *[f"CAST({p} AS VARCHAR)" for p in parts]]) + ")"


def sql_strip(col: str) -> str:
    return rf"regexp_replace({col}, '^[\s\x{{00A0}}\x{{0085}}\x{{2028}}\x{{2029}}]+|[\s\x{{00A0}}\x{{0085}}\x{{2028}}\x{{2029}}]+$', '', 'g')"
