"""Runs registered queries against their SQL: python tests/compare.py [sf] [names or prefixes...]."""

from __future__ import annotations

import math
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb
from pyspark.sql import SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def session(cores: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return f"{v:.6g}" if v else "0"
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, int):
        return f"{float(v):.12g}"
    if hasattr(v, "asDict"):
        return plain(v.asDict())
    if isinstance(v, dict):
        return str(sorted((str(k), plain(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows), [columns[i] for i in order]


def check(spark, con, name, fn, sql, folder):
    """(spark seconds, number of rows, problem or None)."""
    start = time.time()
    df = fn(spark, folder)
    got, cols = rows_of(df.columns, df.collect())
    took = time.time() - start
    if sql is None:
        return took, len(got), None if got else "no rows"
    rel = con.sql(sql)
    want, wcols = rows_of(rel.columns, rel.fetchall())
    if cols != wcols:
        return took, len(got), f"columns {cols} vs {wcols}"
    if len(got) != len(want):
        return took, len(got), f"{len(got)} rows vs {len(want)}"
    for g, w in zip(got, want):
        if g != w:
            bad = sum(a != b for a, b in zip(got, want))
            return took, len(got), f"{bad} rows differ, first {g} vs {w}"
    return took, len(got), None


def main() -> int:
    from trustframe import checks

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    wanted = sys.argv[2:]
    checks.load_all()
    spark, folder = session(), f"/root/testdata/sf{sf}"
    con = connect(folder)
    failed = 0
    for name, fn in checks.QUERIES.items():
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            if not any(w.startswith("@") and fn.__module__.endswith(w[1:]) for w in wanted):
                continue
        try:
            took, n, problem = check(spark, con, name, fn, checks.ORACLES.get(name), folder)
        except Exception as e:  # the report shows what broke
            took, n, problem = 0, 0, f"{type(e).__name__}: {str(e)[:700]}"
            if os.environ.get("TRACE"):
                raise
        failed += problem is not None
        kind = "sql" if name in checks.ORACLES else "rows"
        print(f"{'FAIL' if problem else 'ok':4} {name:28} {kind:4} {n:7} rows {took:6.2f}s {problem or ''}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(min(1, main()))
