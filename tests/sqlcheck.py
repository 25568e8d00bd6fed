"""Runs registered queries beside their SQL and compares row counts and values.

    python tests/sqlcheck.py [--sf DIR] [key ...]
"""

import argparse
import datetime
import math
import os
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from vendorlens.session import build_session
from vendorlens.verify.catalog import ORACLES, QUERIES

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def connect(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    return con


def compare(spark, con, sf, key):
    """(ok, message) for one key."""
    df = QUERIES[key](spark, sf)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if key not in ORACLES:
        return True, f"rows only: {len(got)}"
    found = con.execute(ORACLES[key])
    names = [d[0] for d in found.description]
    want = rows_of(names, found.fetchall())
    if sorted(names) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} want {sorted(names)}"
    if got != want:
        extra = [r for r in got if r not in set(want)][:2]
        missing = [r for r in want if r not in set(got)][:2]
        return False, f"rows {len(got)} want {len(want)}; extra {extra} missing {missing}"
    return True, f"{len(got)} rows"


def main():
    parser = argparse.ArgumentParser()
    parser.add_argument("keys", nargs="*")
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    args = parser.parse_args()
    spark = build_session("local[8]", **{
        "spark.checkpoint.dir": f"file:/tmp/vendorlens-check-{os.getpid()}",
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(args.sf)
    bad = 0
    for key in args.keys or QUERIES:
        start = time.time()
        try:
            ok, text = compare(spark, con, args.sf, key)
        except Exception as error:  # a broken query must not hide the others
            ok, text = False, f"{type(error).__name__}: {str(error)[:600]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {key:26s} {time.time() - start:5.1f}s {text}", flush=True)
    print(f"{bad} of {len(args.keys or QUERIES)} failed")
    spark.stop()


if __name__ == "__main__":
    main()
