"""Run registered queries beside their SQL checks and compare all rows.

    python tests/compare.py [--sf 0.01] [name-prefix ...]
"""

from __future__ import annotations

import argparse
import decimal
import math
import sys
import time
import traceback
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from waystone.plans import views  # noqa: E402
from waystone.plans.catalogue import CHECKS, QUERIES  # noqa: E402


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in views.RAW:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def cell(value):
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, (float, decimal.Decimal)):
        value = float(value)
        return "nan" if math.isnan(value) else f"{round(value, 4) + 0.0:.4f}"
    if isinstance(value, dict):
        return str(sorted((str(k), cell(v)) for k, v in value.items()))
    if isinstance(value, (list, tuple)):
        return str([cell(v) for v in value])
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, con, name: str, sf_dir: str) -> str:
    """Empty when equal, else what differs."""
    df = QUERIES[name](spark, sf_dir)
    got_columns, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if name not in CHECKS:
        return "" if got else "no rows"
    cursor = con.execute(CHECKS[name])
    columns = [d[0] for d in cursor.description]
    want_columns, want = rows_of(columns, cursor.fetchall())
    if got_columns != want_columns:
        return f"columns {got_columns} != {want_columns}"
    if not want:
        return "the check gives no rows"
    if got != want:
        only_got = sorted(set(got) - set(want))[:3]
        only_want = sorted(set(want) - set(got))[:3]
        return f"{len(got)} rows, want {len(want)}; extra {only_got}; missing {only_want}"
    return ""


def main() -> int:
    from pyspark.sql import SparkSession

    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("--partitions", default="8")
    parser.add_argument("--zone", default="UTC")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    builder = SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
    builder = builder.config("spark.sql.shuffle.partitions", args.partitions)
    builder = builder.config("spark.sql.session.timeZone", args.zone)
    spark = builder.config("spark.driver.memory", "12g").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    sf_dir = f"/root/testdata/sf{args.sf}"
    con = connect(sf_dir)
    failed = 0
    for name in QUERIES:
        if args.names and not any(name.startswith(p) for p in args.names):
            continue
        start = time.time()
        try:
            problem = compare(spark, con, name, sf_dir)
        except Exception as error:  # keep going: report every query
            lines = str(error).splitlines() or [repr(error)]
            problem = lines[0][:600]
            if not isinstance(error, duckdb.Error):
                problem += "\n" + "".join(traceback.format_exc().splitlines(True)[-6:])[:800]
        failed += bool(problem)
        label = "ok  " if not problem else "FAIL"
        checked = "sql" if name in CHECKS else "rows"
        print(f"{label} {name:32s} {checked} {time.time() - start:6.1f}s {problem[:900]}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(main())
