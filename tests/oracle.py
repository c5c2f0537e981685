"""Run registered queries next to their SQL twins in DuckDB and compare whole results.

    python tests/oracle.py [--sf 0.01] [name ...]
"""

from __future__ import annotations

import argparse
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(row[i] for i in order)) for row in rows)


def compare(spark, con, sf_dir: str, registered) -> str:
    start = time.time()
    df = registered(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    took = time.time() - start
    if registered.sql is None:
        return f"rows {len(got):>7} {took:6.2f}s (no SQL twin)"
    start = time.time()
    rel = con.execute(registered.sql)
    columns = [d[0] for d in rel.description]
    want = rel.fetchall()
    sql_took = time.time() - start
    if sorted(columns) != sorted(df.columns):
        return f"FAIL columns {sorted(df.columns)} != {sorted(columns)}"
    a, b = canonical(got, df.columns), canonical(want, columns)
    if a == b:
        return f"ok   {len(got):>7} {took:6.2f}s duckdb {sql_took:.2f}s"
    only_a, only_b = sorted(set(a) - set(b)), sorted(set(b) - set(a))
    return f"FAIL rows {len(a)} vs {len(b)}; sorted columns {sorted(columns)}\n   spark {only_a[:3]}\n   duckdb {only_b[:3]}"


def main() -> None:
    from prefspark.plans import load_all
    from prefspark.session import local_session

    parser = argparse.ArgumentParser()
    parser.add_argument("names", nargs="*")
    parser.add_argument("--sf", default="0.01")
    args = parser.parse_args()
    sf_dir = f"/root/testdata/sf{args.sf}"
    spark, con = local_session("oracle"), connect(sf_dir)
    registry = load_all()
    names = [n for n in registry if not args.names or any(n == a or registry[n].build.__module__.endswith("." + a) for a in args.names)]
    failed = 0
    for name in names:
        try:
            line = compare(spark, con, sf_dir, registry[name])
        except Exception as error:  # noqa: BLE001 - report and go on with the other queries
            line = f"FAIL {type(error).__name__}: {str(error)[:600]}"
        failed += line.startswith("FAIL")
        print(f"{name:32s} {line}", flush=True)
    print(f"{len(names)} run, {failed} failed")


if __name__ == "__main__":
    main()
