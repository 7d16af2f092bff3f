"""Run registered queries on Spark and their SQL on DuckDB and compare whole results.

    python tests/oracle_check.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    return con


def cell(x):
    if isinstance(x, float):
        return "NULL" if math.isnan(x) else repr(x + 0.0)
    return "NULL" if x is None else str(x)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, con, sf, name, fn, sql):
    t = time.time()
    df = fn(spark, sf)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    spent = time.time() - t
    if sql is None:
        return f"rows-only {len(got)} rows {spent:.1f}s"
    t = time.time()
    rel = con.sql(sql)
    want = rows_of(rel.columns, rel.fetchall())
    other = time.time() - t
    kinds = dict(zip(rel.columns, [str(x) for x in rel.types]))
    note = ""
    for column, kind in df.dtypes:
        expected = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
        if expected.get(kind, kind) != kinds.get(column):
            note += f" [{column}: {kind} vs {kinds.get(column)}]"
    if sorted(df.columns) != sorted(rel.columns):
        return f"MISMATCH columns {sorted(df.columns)} vs {sorted(rel.columns)}"
    if got == want:
        return f"ok {len(got)} rows spark {spent:.1f}s sql {other:.1f}s{note}"
    only_got = [r for r in got if r not in set(want)][:3]
    only_want = [r for r in want if r not in set(got)][:3]
    return f"MISMATCH {len(got)} vs {len(want)} {sorted(df.columns)}\n   spark {only_got}\n   sql   {only_want}{note}"


def main():
    import __spark_entry__ as entry
    from standout.session import local_session

    args = sys.argv[1:]
    sf = "/root/testdata/sf0.01"
    if args[:1] == ["--sf"]:
        sf, args = args[1], args[2:]
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    oracles = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if args and not any(name == a or (a.endswith("*") and name.startswith(a[:-1])) for a in args):
            continue
        try:
            out = compare(spark, con, sf, name, fn, oracles.get(name))
        except Exception as e:  # report and go on with the next query
            out = f"MISMATCH error {type(e).__name__}: {str(e)[:600]}"
        bad += out.startswith("MISMATCH")
        print(f"{name}: {out}", flush=True)
    print("bad", bad)
    sys.exit(bool(bad))


if __name__ == "__main__":
    main()
