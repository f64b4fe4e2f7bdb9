"""Run registered queries against their SQL and print what differs.

    python tests/oracle_check.py [folder] [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb

import __spark_entry__ as entry
from tests.conftest import make_session

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if hasattr(value, "isoformat"):
        return str(value).replace("+00:00", "")
    if isinstance(value, (list, tuple)):
        return str([plain(v) for v in value])
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, db, name, folder):
    query, sql = entry.queries()[name], entry.oracle_sql().get(name)
    begin = time.time()
    df = query(spark, folder)
    got = df.collect()
    took = time.time() - begin
    if sql is None:
        return "rows only", len(got), took, ""
    begin = time.time()
    relation = db.execute(sql)
    columns = [d[0] for d in relation.description]
    want = relation.fetchall()
    sql_took = time.time() - begin
    a, b = rows_of(df.columns, got), rows_of(columns, want)
    if a == b:
        return "equal", len(got), took, f"sql {sql_took:.1f}"
    note = f"{a[0]} / {b[0]}" if a[0] != b[0] else ""
    left, right = set(a[1]), set(b[1])
    only = [sorted(left - right)[:2], sorted(right - left)[:2]]
    return "DIFFERENT", len(got), took, f"{note} rows {len(a[1])}/{len(b[1])} spark-only {len(left - right)} {only[0]}\n     sql-only {len(right - left)} {only[1]}"


def main():
    args = sys.argv[1:]
    folder = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.001"
    names = args or list(entry.queries())
    spark = make_session()
    db = duckdb.connect(config={"threads": 8})
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    bad = 0
    for name in names:
        try:
            verdict, n, took, note = compare(spark, db, name, folder)
        except Exception as e:  # noqa: BLE001 - report and go on
            verdict, n, took, note = "ERROR", 0, 0.0, str(e)[:700]
        bad += verdict in ("DIFFERENT", "ERROR")
        print(f"{verdict:10} {name:32} {n:7} {took:6.1f}s {note[:1500]}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
