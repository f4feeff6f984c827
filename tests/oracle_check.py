"""Run catalog queries on Spark and their oracles on DuckDB and compare the rows.

    python -m tests.oracle_check [--sf 0.01] [name or prefix ...]
"""

from __future__ import annotations

import argparse
import math
import sys
import time
from datetime import date, datetime
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def plain(value):
    if value is None:
        return "~"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "~nan"
        return f"{round(value, 6):.6f}"
    if isinstance(value, (datetime, date)):
        return value.isoformat()
    return f"{type(value).__name__}:{value}"


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, folder, run, sql):
    """(ok, message, Spark rows, seconds)"""
    began = time.time()
    df = run(spark, folder)
    ours = df.collect()
    took = time.time() - began
    if sql is None:
        return True, "rows only", len(ours), took
    result = con.sql(sql)
    theirs = result.fetchall()
    if sorted(df.columns) != sorted(result.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(result.columns)}", len(ours), took
    a, b = rows_of(df.columns, ours), rows_of(result.columns, theirs)
    if a == b:
        return True, "match", len(ours), took
    only_a, only_b = sorted(set(a) - set(b))[:2], sorted(set(b) - set(a))[:2]
    return False, f"{len(a)} rows vs {len(b)}\n   {sorted(df.columns)}\n   spark  {only_a}\n   duckdb {only_b}", len(ours), took


def connect(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for file in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def main():
    import __spark_entry__ as contract
    from wirelake.session import local_session

    args = argparse.ArgumentParser()
    args.add_argument("--sf", default="0.01")
    args.add_argument("names", nargs="*")
    args = args.parse_args()
    folder = f"/root/testdata/sf{args.sf}"
    spark, con = local_session(8), connect(folder)
    queries, oracles = contract.queries(), contract.oracle_sql()
    failed = 0
    for name in queries:
        if args.names and not any(name.startswith(x) for x in args.names):
            continue
        try:
            ok, message, n, took = compare(spark, con, folder, queries[name], oracles.get(name))
        except Exception as error:  # report and go on to the next query
            ok, message, n, took = False, f"{type(error).__name__}: {str(error)[:1500]}", -1, 0.0
        failed += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} rows={n} {took:.2f}s {'' if ok and message == 'match' else message}",
              flush=True)
    print(f"failed: {failed}")


if __name__ == "__main__":
    main()
