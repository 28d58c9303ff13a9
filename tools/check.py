"""Run registered queries and their check SQL side by side and compare every value.

    python tools/check.py [--sf 0.01] [--only name,name] [--explain name]
"""

from __future__ import annotations

import argparse
import datetime
import decimal
import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from harborlight import registry, session  # noqa: E402

BASE = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
        "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, int):
        return f"i{value}"
    if isinstance(value, decimal.Decimal):
        return f"dec{value}"
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return str(value)


def table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


SAME_TYPE = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
             "timestamp_ntz": "TIMESTAMP", "date": "DATE"}


def type_notes(df, cur):
    """Columns whose Spark and DuckDB types differ."""
    theirs = {d[0]: str(d[1]) for d in cur.description}
    bad = [f"{n}:{k}/{theirs[n]}" for n, k in df.dtypes if n in theirs and SAME_TYPE.get(k) != theirs[n]]
    return f"  types {bad}" if bad else ""


def compare(spark, con, name, q, folder):
    start = time.time()
    df = q(spark, folder)
    got = table(df.columns, df.collect())
    took = time.time() - start
    sql = registry.all_oracles().get(name)
    if sql is None:
        return "ROWS", len(got[1]), took, ""
    cur = con.execute(sql)
    kinds = type_notes(df, cur)
    want = table([d[0] for d in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return "COLUMNS", len(got[1]), took, f"\n   spark {got[0]}\n   check {want[0]}"
    if got[1] == want[1]:
        return "ok" if got[1] else "EMPTY", len(got[1]), took, kinds
    left, right = set(got[1]) - set(want[1]), set(want[1]) - set(got[1])
    note = f" rows {len(got[1])}/{len(want[1])} differing {len(left)}/{len(right)}\n   {got[0]}"
    for side, rows in (("spark", left), ("check", right)):
        for row in sorted(rows)[:2]:
            note += f"\n   {side} {row}"
    return "DIFF", len(got[1]), took, note


def main():
    p = argparse.ArgumentParser()
    p.add_argument("--sf", default="0.01")
    p.add_argument("--only", default="")
    p.add_argument("--skip", default="")
    p.add_argument("--explain", default="")
    args = p.parse_args()
    folder = f"/root/testdata/sf{args.sf}"
    spark = session.local_session(cores=8)
    found = registry.all_queries()
    if args.explain:
        found[args.explain](spark, folder).explain("formatted")
        return
    con = duckdb.connect()
    for t in BASE:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    only = [x for x in args.only.split(",") if x]
    skip = [x for x in args.skip.split(",") if x]
    bad = []
    for name, q in found.items():
        if (only and name not in only) or name in skip:
            continue
        try:
            state, rows, took, note = compare(spark, con, name, q, folder)
        except Exception as e:  # report and go on with the next query
            state, rows, took = "ERROR", 0, 0.0
            note = "\n" + "".join(traceback.format_exception_only(e))[:1500]
        if state not in ("ok", "ROWS"):
            bad.append(name)
        print(f"{state:8}{name:28}{rows:8d} {took:6.2f}s{note}", flush=True)
    print(f"{len(bad)} not ok: {bad}")


if __name__ == "__main__":
    main()
