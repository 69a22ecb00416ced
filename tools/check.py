"""Run catalogue queries on Spark and their reference SQL on DuckDB and compare.

usage: check.py [--sf DIR] [--only m1,m2] [--match PREFIX] [names...]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from tillwise.plans import registry  # noqa: E402
from tillwise.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~null"
    if isinstance(v, float):
        return "0.0" if v == 0 else repr(v)
    return str(v)


def rows_of(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in data)


def close(a, b):
    try:
        return math.isclose(float(a), float(b), rel_tol=1e-9, abs_tol=1e-9)
    except ValueError:
        return a == b


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--module")
    ap.add_argument("names", nargs="*")
    a = ap.parse_args()
    spark = local_session("8")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{a.sf}/{t}.parquet'")
    if a.module:
        registry.MODULES = tuple(a.module.split(","))
    qs, sqls = registry.spark_queries(), registry.reference_sql()
    bad = 0
    for name in a.names or qs:
        t0 = time.time()
        try:
            df = qs[name](spark, a.sf)
            data = [tuple(r) for r in df.collect()]
            cols = df.columns
        except Exception as e:
            bad += 1
            print(f"ERR   {name}: spark {str(e)[:1200]}", flush=True)
            if os.environ.get("TRACE"):
                traceback.print_exc()
            continue
        t1 = time.time()
        if name not in sqls:
            print(f"rows  {name}: {len(data)} rows {t1-t0:.1f}s", flush=True)
            continue
        try:
            cur = con.execute(sqls[name])
            want_cols = [d[0] for d in cur.description]
            want = cur.fetchall()
        except Exception as e:
            bad += 1
            print(f"ERR   {name}: sql {str(e)[:900]}", flush=True)
            continue
        took = f"{t1-t0:.1f}s/{time.time()-t1:.1f}s"
        if sorted(cols) != sorted(want_cols):
            bad += 1
            print(f"COLS  {name}: {sorted(cols)} vs {sorted(want_cols)}", flush=True)
            continue
        got, exp = rows_of(cols, data), rows_of(want_cols, want)
        if got == exp:
            note = "" if got else "  EMPTY"
            print(f"ok    {name}: {len(got)} rows {took}{note}", flush=True)
            continue
        near = len(got) == len(exp) and all(
            all(close(x, y) for x, y in zip(r, s)) for r, s in zip(got, exp)
        )
        bad += 1
        sg, se = set(got), set(exp)
        print(f"{'NEAR' if near else 'DIFF'}  {name}: {len(got)} vs {len(exp)} rows {took} cols {sorted(cols)}")
        for r in sorted(sg - se)[:3]:
            print("      spark ", str(r)[:400])
        for r in sorted(se - sg)[:3]:
            print("      duckdb", str(r)[:400], flush=True)
    print("not matching:", bad)


if __name__ == "__main__":
    main()
