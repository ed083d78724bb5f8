"""Runs registered queries beside their SQL twins in an in-process DuckDB and compares every value.

usage: python tools/check.py [--sf DIR] [name-substring ...]
"""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidewatch.queries import ORACLE, QUERIES  # noqa: E402
from tidewatch.session import build  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def cell(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return f"b{v}"
    if isinstance(v, float):
        return "~" if math.isnan(v) else f"f{v!r}"
    if isinstance(v, decimal.Decimal):
        return f"d{v.normalize()}"
    if isinstance(v, datetime.datetime):
        return f"t{v.replace(tzinfo=None).isoformat()}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(cell(x) for x in v) + "]"
    return f"{type(v).__name__}{v}"


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted("|".join(cell(r[i]) for i in order) for r in rows)


def compare(spark, con, sf, name):
    started = time.time()
    df = QUERIES[name](spark, sf)
    got_cols, got = table(df.columns, [tuple(r) for r in df.collect()])
    spent = time.time() - started
    if name not in ORACLE:
        return spent, f"rows only ({len(got)})", True
    started = time.time()
    cur = con.execute(ORACLE[name])
    want_cols, want = table([d[0] for d in cur.description], cur.fetchall())
    duck = time.time() - started
    if got_cols != want_cols:
        return spent, f"columns {got_cols} != {want_cols}", False
    if got != want:
        a, b = set(got) - set(want), set(want) - set(got)
        return spent, (
            f"rows {len(got)} vs {len(want)}; only spark {len(a)} {sorted(a)[:3]}; "
            f"only sql {len(b)} {sorted(b)[:3]}"
        ), False
    return spent, f"equal, {len(got)} rows, sql {duck:.1f}s", True


def main():
    args = sys.argv[1:]
    sf = "/root/testdata/sf0.01"
    if args[:1] == ["--sf"]:
        sf, args = args[1], args[2:]
    spark = build(
        master="local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
           "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    bad = []
    for name in QUERIES:
        if args and not any(a in name for a in args):
            continue
        try:
            spent, note, ok = compare(spark, con, sf, name)
        except Exception as e:  # report and go on
            spent, note, ok = 0.0, f"ERROR {type(e).__name__}: {str(e)[:600]}", False
        print(f"{'ok  ' if ok else 'BAD '} {name:48s} {spent:6.2f}s {note}", flush=True)
        if not ok:
            bad.append(name)
    print(f"{len(bad)} bad: {bad}")


if __name__ == "__main__":
    main()
