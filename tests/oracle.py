"""Run registered queries against DuckDB over the same Parquet tables.

Command line: python -m tests.oracle [--sf 0.01] [name ...]
"""

from __future__ import annotations

import argparse
import datetime as dt
import decimal
import math
import sys
import time

import duckdb
from pyspark.sql import SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
DATA = "/root/testdata"


def make_session() -> SparkSession:
    spark = (
        SparkSession.builder.master("local[8]")
        .appName("stationwise-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _norm(x):
    if x is None:
        return None
    if isinstance(x, bool):
        return ("b", x)
    if isinstance(x, (int,)):
        return ("i", x)
    if isinstance(x, (float, decimal.Decimal)):
        x = float(x)
        if math.isnan(x):
            return ("f", "nan")
        return ("f", repr(x))
    if isinstance(x, dt.datetime):
        return ("t", x.replace(tzinfo=None).isoformat())
    if isinstance(x, dt.date):
        return ("d", x.isoformat())
    return ("s", str(x))


def compare(spark, con, sf_dir, fn, sql):
    """Returns (ok, message, n_rows, seconds)."""
    t0 = time.time()
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    took = time.time() - t0
    if sql is None:
        return True, "rows only", len(got), took
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(cols) != sorted(df.columns):
        return False, f"columns {sorted(set(cols) ^ set(df.columns))}", len(got), took
    order_s = [df.columns.index(c) for c in sorted(cols)]
    order_d = [cols.index(c) for c in sorted(cols)]
    key = lambda r: tuple(str(v) for v in r)
    a = sorted((tuple(_norm(r[i]) for i in order_s) for r in got), key=key)
    b = sorted((tuple(_norm(r[i]) for i in order_d) for r in want), key=key)
    if len(a) != len(b):
        return False, f"rows {len(a)} vs {len(b)}; spark {a[:1]} duck {b[:1]}", len(got), took
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        x, y = bad[0]
        names = sorted(cols)
        diff = {n: (p, q) for n, p, q in zip(names, x, y) if p != q}
        return False, f"{len(bad)} rows differ; first {diff} in {x}", len(got), took
    return True, "match", len(got), took


def main() -> int:
    from stationwise import catalog

    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("--module", default=None)
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    if args.module:
        catalog.MODULES = tuple(args.module.split(","))
    queries, sqls = catalog.load()
    spark = make_session()
    sf_dir = f"{DATA}/sf{args.sf}"
    con = duck(sf_dir)
    failed = 0
    for name, fn in queries.items():
        if args.names and name not in args.names:
            continue
        try:
            ok, msg, n, took = compare(spark, con, sf_dir, fn, sqls.get(name))
        except Exception as e:  # noqa: BLE001
            ok, msg, n, took = False, f"{type(e).__name__}: {str(e)[:600]}", -1, 0.0
        failed += not ok or n == 0
        flag = "ok  " if ok and n else "FAIL"
        print(f"{flag} {name:34s} rows={n:<7d} {took:6.2f}s {'' if ok and n else msg}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(main())
