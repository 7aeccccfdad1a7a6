"""Knowledge bundles: folders of Markdown files with a front matter header."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

HEADER = r"(?s)^[ \t]*---[ \t]*\n(?:(.*?)\n)??[ \t]*---[ \t]*(?:\n|$)(.*)$"
META = T.MapType(T.StringType(), T.StructType([T.StructField("text", T.StringType()), T.StructField("items", T.ArrayType(T.StringType()))]))
_KEY_LINE = re.compile(r"([A-Za-z_][A-Za-z0-9_-]*):[ \t]*(.*)")
_BLOCK_MARKS = {"", ">", "|", ">-", "|-", ">+", "|+"}


def _unquoted(value: str) -> str:
    value = value.strip()
    quoted = len(value) > 1 and value[0] in "\"'" and value[-1] == value[0]
    return value[1:-1] if quoted else value


def _block_value(lines: list[str]) -> dict | None:
    """Value of the indented or listed lines under a key: a list of plain items, folded text, or nothing."""
    body = [line.strip() for line in lines if line.strip()]
    listed = [line.startswith("- ") for line in body]
    if body and all(listed):
        items = [line[2:].strip() for line in body]
        plain = all(item[:1] in ("'", '"') or ":" not in item for item in items)
        return {"text": None, "items": [_unquoted(item) for item in items]} if plain else None
    if body and not any(mark or _KEY_LINE.match(line) for mark, line in zip(listed, body)):
        return {"text": " ".join(body), "items": None}
    return None


def _header_values(header: str | None) -> dict:
    """Top-level scalars and lists of one header; nested mappings are skipped, the first value of a key counts for
    blocks and the last for one-line values."""
    sections: list[tuple[str, str, list[str]]] = []
    for line in (header or "").split("\n"):
        m = _KEY_LINE.fullmatch(line)
        if m:
            sections.append((m[1], m[2].strip(), []))
        elif sections:
            sections[-1][2].append(line)
    found: dict = {}
    for key, value, lines in sections:
        if value not in _BLOCK_MARKS:
            if value.startswith("[") and value.endswith("]"):
                found[key] = {"text": None, "items": [_unquoted(v) for v in value[1:-1].split(",") if v.strip()]}
            elif not value.startswith("{"):
                found[key] = {"text": _unquoted(value), "items": None}
        if key not in found:
            block = _block_value(lines)
            if block:
                found[key] = block
    return found


@F.pandas_udf(META)
def _header_map(headers: pd.Series) -> pd.Series:
    return headers.map(_header_values)


def parse(files: DataFrame, path: str = "path", content: str = "text") -> DataFrame:
    """(path, meta, body): files without a closed header keep their whole text as body. Header and body are split
    natively; only the few header lines go through the Arrow helper."""
    unix = F.replace(F.col(content), F.lit("\r\n"), F.lit("\n"))
    has = unix.rlike(HEADER)
    return files.select(F.col(path).alias("path"), _header_map(F.when(has, F.regexp_extract(unix, HEADER, 1))).alias("meta"),
                        F.when(has, F.regexp_replace(F.regexp_extract(unix, HEADER, 2), r"^\n+", "")).otherwise(F.col(content)).alias("body"))


def documents(parsed: DataFrame, include_deprecated: bool = False) -> DataFrame:
    """(path, title, text) of the concept files: Markdown only, no index.md or log.md, not deprecated, not empty."""
    clean = F.regexp_replace(F.replace("path", F.lit("\\"), F.lit("/")), "^/+|/+$", "")
    parts = F.split(clean, "/")
    name = F.element_at(parts, -1)
    scalar = lambda key: F.nullif(F.col("meta")[key]["text"], F.lit(""))
    stem = F.translate(F.substring(name, F.lit(1), F.length(name) - 3), "_-", "  ")
    title = F.coalesce(scalar("title"), stem)
    where = F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), " / ")
    tags = F.col("meta")["tags"]["items"]
    tag_line = F.when(F.size(tags) > 0, F.concat(F.lit("Tags: "), F.array_join(tags, ", ")))
    trim: Column = F.regexp_replace("body", r"(?U)^\s+|\s+$", "")
    text = F.regexp_replace(F.concat_ws("\n\n", scalar("description"), tag_line, trim), r"(?U)^\s+|\s+$", "")
    rows = parsed.filter(F.lower(name).endswith(".md") & ~F.lower(name).isin("index.md", "log.md"))
    if not include_deprecated:
        rows = rows.filter(F.coalesce(F.lower(F.col("meta")["status"]["text"]) != "deprecated", F.lit(True)))
    return rows.select("path", F.when(where != "", F.concat(where, F.lit(" / "), title)).otherwise(title).alias("title"),
                       text.alias("text")).filter(F.col("text") != "")


def load_bundle(spark: SparkSession, root: str, include_deprecated: bool = False) -> DataFrame:
    """Documents of the bundle in a folder, on any file system Spark can read."""
    base = root.rstrip("/")
    files = (spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True)
             .option("pathGlobFilter", "*.md").load(base).select("_metadata.file_path", F.col("value").alias("text")))
    plain = F.url_decode(F.replace(F.col("file_path"), F.lit("+"), F.lit("%2B")))  # a plus in a file name is no space
    inside = F.regexp_replace(plain, "^.*?" + re.escape(base.split(":", 1)[-1].lstrip("/")) + "/", "")
    return documents(parse(files.select(inside.alias("path"), "text")), include_deprecated)
