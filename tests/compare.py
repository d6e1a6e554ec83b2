"""Run registered queries and their check statements side by side.

    python -m tests.compare [--sf DIR] [--only a,b] [--plans]
"""

from __future__ import annotations

import argparse
import datetime as dt
import decimal
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return f"{value:.9g}" if value != int(value) or abs(value) > 1e15 else str(int(value))
    if isinstance(value, decimal.Decimal):
        return str(value)
    if isinstance(value, int):
        return str(value)
    if isinstance(value, (dt.datetime, dt.date)):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return str(value)


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([columns[i] for i in order] and [plain(r[i]) for i in order] for r in rows), key=repr)


def compare(spark, name, build, sql, sf_dir, con) -> tuple[str, float, float]:
    t0 = time.time()
    frame = build(spark, sf_dir)
    rows = [tuple(r) for r in frame.collect()]
    spark_seconds = time.time() - t0
    if sql is None:
        return f"rows-only {len(rows)}", spark_seconds, 0.0
    t0 = time.time()
    cursor = con.execute(sql)
    expected_columns = [d[0] for d in cursor.description]
    expected = cursor.fetchall()
    sql_seconds = time.time() - t0
    if sorted(frame.columns) != sorted(expected_columns):
        return f"COLUMNS {sorted(frame.columns)} vs {sorted(expected_columns)}", spark_seconds, sql_seconds
    left, right = canonical(frame.columns, rows), canonical(expected_columns, expected)
    if left != right:
        only_left = [r for r in left if r not in right][:2] if len(left) < 20000 else left[:2]
        only_right = [r for r in right if r not in left][:2] if len(right) < 20000 else right[:2]
        return (f"DIFF rows {len(left)} vs {len(right)}\n   spark {only_left}\n   sql   {only_right}",
                spark_seconds, sql_seconds)
    return f"ok {len(left)}", spark_seconds, sql_seconds


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("--only", default="")
    parser.add_argument("--module", default="")
    parser.add_argument("--plans", action="store_true")
    args = parser.parse_args()
    from ledgerlight.plans.catalog import ORACLES, QUERIES
    from ledgerlight.session import build_session

    spark = build_session("compare", master="local[8]", partitions=8, **{"spark.driver.memory": "12g"})
    con = connect(args.sf)
    names = [n for n in QUERIES if not args.only or n in args.only.split(",")]
    if args.module:
        import importlib
        from ledgerlight.plans import registry
        names = [n for n in names if registry.HOME.get(n) in args.module.split(",")]
        importlib.invalidate_caches()
    failed = []
    for name in names:
        try:
            if args.plans:
                print("=====", name)
                QUERIES[name](spark, args.sf).explain("formatted")
                continue
            outcome, a, b = compare(spark, name, QUERIES[name], ORACLES.get(name), args.sf, con)
        except Exception as error:  # report and go on with the next query
            outcome, a, b = f"ERROR {type(error).__name__}: {str(error)[:600]}", 0.0, 0.0
        if not outcome.startswith(("ok", "rows-only")) or outcome == "ok 0":
            failed.append(name)
        print(f"{name:32s} {a:6.2f}s {b:6.2f}s {outcome}", flush=True)
    print("FAILED:", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
