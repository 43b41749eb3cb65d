"""Runs every query next to its SQL twin and prints what differs.

    python tools/check_oracle.py [sf_dir] [name prefix ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from votespan.session import build_session  # noqa: E402
from workload import ORACLE, QUERIES  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "item"):
        v = v.item()
    return float(v) if isinstance(v, float) else v


def spark_rows(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)


def duck_rows(con, sql):
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    cols = sorted(names)
    at = [names.index(c) for c in cols]
    return cols, sorted((tuple(plain(r[i]) for i in at) for r in got.fetchall()), key=repr)


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def differences(spark, con, name, sf_dir):
    """None if query and twin agree, else what differs."""
    if name not in ORACLE:
        return "no twin"
    cols, rows = spark_rows(QUERIES[name](spark, sf_dir))
    want_cols, want = duck_rows(con, ORACLE[name])
    if cols != want_cols:
        return f"columns {cols} != {want_cols}"
    if len(rows) != len(want):
        return f"{len(rows)} rows != {len(want)}"
    types = {tuple(type(v) for v in r) for r in rows[:50]} ^ {tuple(type(v) for v in r) for r in want[:50]}
    bad = [(a, b) for a, b in zip(rows, want) if a != b]
    if bad:
        return f"{len(bad)} of {len(rows)} rows differ, e.g. {bad[0]}"
    return f"types differ: {types}" if types else None


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = tuple(sys.argv[2:])
    spark = build_session(master="local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="16g", spark__ui__enabled="false")
    spark.sparkContext.setLogLevel("ERROR")
    con, failed = connect(sf_dir), 0
    for name in QUERIES:
        if prefixes and not name.startswith(prefixes):
            continue
        start = time.time()
        try:
            found = differences(spark, con, name, sf_dir)
        except Exception as e:  # noqa: BLE001 - report and go on
            found = f"{type(e).__name__}: {str(e)[:1500]}"
        kind = "sql " if name in ORACLE else "rows"
        print(f"{'ok  ' if found is None else 'FAIL'} {kind} {time.time() - start:6.2f}s {name} {found or ''}", flush=True)
        failed += found is not None
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
