"""Compare every query with its SQL in DuckDB.

Run `python tests/oracle.py [sf_dir] [name prefix ...]` for a report.
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(value):
    if hasattr(value, "asDict"):
        return tuple(plain(v) for v in value)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((plain(k), plain(v)) for k, v in value.items()))
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    return value


def table_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    body = sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)
    return names, body


def difference(spark, con, sf_dir, run, statement) -> str | None:
    df = run(spark, sf_dir)
    names, got = table_of(df.columns, df.collect())
    cursor = con.execute(statement)
    want_names, want = table_of([d[0] for d in cursor.description], cursor.fetchall())
    if names != want_names:
        return f"columns {names} != {want_names}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}: {str(got[:2])[:300]} | {str(want[:2])[:300]}"
    for a, b in zip(got, want):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return f"{len(got)} rows, first difference {str(a)[:400]} | {str(b)[:400]}"
    return None


def session(cores: int = 8):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> int:
    from __spark_entry__ import oracle_sql, queries

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    spark, con, failed = session(), connect(sf_dir), 0
    statements = oracle_sql()
    for name, run in queries().items():
        if args and not any(name.startswith(a) for a in args):
            continue
        started = time.perf_counter()
        try:
            if name in statements:
                problem = difference(spark, con, sf_dir, run, statements[name])
                note = "ok" if problem is None else f"DIFF {problem}"
            else:
                df = run(spark, sf_dir)
                rows = df.collect()
                problem, note = None, f"rows only: {len(rows)} {str(rows[:1])[:200]}"
        except Exception as error:
            problem = note = f"ERROR {str(error)[:700]}"
        failed += problem is not None
        print(f"{name:36s} {time.perf_counter() - started:6.2f}s {note}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
