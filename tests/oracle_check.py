"""Run queries beside their SQL twins and compare rows: python tests/oracle_check.py [--sf 0.01] [--timeout-free] [names]"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), ".."))

import duckdb  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return value


def same(a, b) -> bool:
    if isinstance(a, (int, float)) and isinstance(b, (int, float)) and not isinstance(a, bool) and not isinstance(b, bool):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-6)
    return a == b


def rows_of(names: list[str], rows: list) -> list[list]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(([plain(row[i]) for i in order] for row in rows), key=repr)


def compare(df, con, sql: str, times: list) -> str:
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    times.append(time.perf_counter())
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows_of(names, cur.fetchall())
    times.append(time.perf_counter())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    types = dict(zip(names, [str(d[1]) for d in cur.description]))
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    odd = [f"{c}: {d} / {types[c]}" for c, d in df.dtypes if kinds.get(d, d) != types[c]]
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}; first: {got[:2]} / {want[:2]}"
    for g, w in zip(got, want):
        if len(g) != len(w) or not all(same(x, y) for x, y in zip(g, w)):
            return f"row {g} != {w}"
    return "ok" + (f" ({len(got)} rows)") + (f" TYPES {odd}" if odd else "") + (" EMPTY" if not got else "")


def main() -> None:
    from plumbline.session import local_session
    import __spark_entry__ as e

    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    folder = f"/root/testdata/sf{args.sf}"
    spark = local_session("8")

    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    oracles = e.oracle_sql()
    for name, fn in e.queries().items():
        if args.names and not any(n == name or (n.endswith("*") and name.startswith(n[:-1])) for n in args.names):
            continue
        times = [time.perf_counter()]
        try:
            df = fn(spark, folder)
            verdict = compare(df, con, oracles[name], times) if name in oracles else f"rows only: {len(df.collect())}"
        except Exception as err:  # noqa: BLE001
            verdict = f"ERROR {type(err).__name__}: {str(err)[:700]}"
        bad += not verdict.startswith(("ok", "rows only"))
        print(f"{name:32s} {' / '.join(f"{b - a:5.1f}" for a, b in zip(times, times[1:])):14s} {verdict[:900]}", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main()
