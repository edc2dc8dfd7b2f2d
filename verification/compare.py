"""Run the Spark queries next to their SQL and compare rows: python -m verification.compare DIR [query ...]"""

from __future__ import annotations

import sys
import time

import duckdb

from verification.oracle import ORACLE
from verification.spark_queries import QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    if isinstance(v, float):
        return f"{v:.6f}"
    return str(v)


def rows_of(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(_norm(r[i]) for i in order) for r in data)


def compare(spark, con, sf_dir: str, name: str) -> str:
    """'' when equal, else what differs."""
    df = QUERIES[name](spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(ORACLE[name])
    want = rows_of([c[0] for c in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if got[1] == want[1]:
        return ""
    a, b = set(got[1]), set(want[1])
    return (f"{len(got[1])} rows != {len(want[1])} rows; {got[0]}\n   only spark: {sorted(a - b)[:2]}"
            f"\n   only sql:   {sorted(b - a)[:2]}")


def main():
    from tests.session import local_session

    sf_dir, only = sys.argv[1], sys.argv[2:]
    spark, con = local_session(), connect(sf_dir)
    bad = 0
    for name in QUERIES:
        if (only and name not in only) or name not in ORACLE:
            continue
        t = time.time()
        try:
            diff = compare(spark, con, sf_dir, name)
        except Exception as e:  # noqa: BLE001 - report and go on
            diff = f"{type(e).__name__}: {str(e)[:700]}"
        bad += bool(diff)
        print(f"{'ok  ' if not diff else 'FAIL'} {name} {time.time() - t:.1f}s {diff}", flush=True)
    print("without SQL:", sorted(set(QUERIES) - set(ORACLE)), "stale:", sorted(set(ORACLE) - set(QUERIES)))
    print("failed:", bad)


if __name__ == "__main__":
    main()
