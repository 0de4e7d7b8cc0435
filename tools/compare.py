"""Run catalogue queries in Spark and their oracles in DuckDB and compare the rows."""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

from gridtrend.catalogue import ORACLES, QUERIES
from gridtrend.session import local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def oracle(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, float):
        return repr(v + 0.0)
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, con, name, folder):
    df = QUERIES[name](spark, folder)
    got = df.collect()
    if name not in ORACLES:
        return len(got), "rows only"
    result = con.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    expected = result.fetchall()
    if sorted(columns) != sorted(df.columns):
        return len(got), f"columns differ: {sorted(set(columns) ^ set(df.columns))}"
    a, b = rows_of(df.columns, got), rows_of(columns, expected)
    if a == b:
        return len(got), "ok"
    if len(a) != len(b):
        return len(got), f"rows differ: spark {len(a)} oracle {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return len(got), f"{len(bad)} values differ, e.g.\n   {bad[0][0]}\n   {bad[0][1]}"


def main():
    folder = sys.argv[1]
    names = sys.argv[2:] or list(QUERIES)
    spark, con = local_session(8), oracle(folder)
    failed = 0
    for name in names:
        start = time.time()
        try:
            n, verdict = compare(spark, con, name, folder)
        except Exception as e:  # report and go on with the next query
            n, verdict = -1, f"ERROR {str(e)[:600]}"
        failed += verdict not in ("ok", "rows only")
        print(f"{name:32s} {n:8d} rows {time.time() - start:6.2f}s  {verdict}", flush=True)
    print(f"{len(names)} queries, {failed} failed")
    sys.exit(failed > 0)


if __name__ == "__main__":
    main()
