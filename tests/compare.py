"""Run queries and compare them with their SQL on the same parquet files.

    python -m tests.compare [--sf 0.01] [name ...]
"""

from __future__ import annotations

import argparse
import datetime
import math
import sys
import time
import traceback

import duckdb
from pyspark.sql import SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def session(cores: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("triagelake")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, (datetime.datetime, datetime.date)):
        return v.isoformat()
    return repr(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(cell(r[i]) for i in order) for r in rows)


def close(a, b) -> bool:
    try:
        return abs(float(a) - float(b)) <= 2e-6 * max(1.0, abs(float(a)))
    except ValueError:
        return a == b


def compare(spark, folder, name, fn, sql):
    started = time.time()
    df = fn(spark, folder)
    got_rows = [tuple(r) for r in df.collect()]
    spark_time = time.time() - started
    got = rows_of(df.columns, got_rows)
    if sql is None:
        return "rows", f"{len(got_rows)} rows", spark_time, 0.0
    started = time.time()
    cur = duck(folder).execute(sql)
    want_rows = cur.fetchall()
    duck_time = time.time() - started
    want = rows_of([c[0] for c in cur.description], want_rows)
    if got[0] != want[0]:
        return "FAIL", f"columns {got[0]} != {want[0]}", spark_time, duck_time
    if got[1] == want[1]:
        status = "ok" if got_rows else "EMPTY"
        return status, f"{len(got_rows)} rows", spark_time, duck_time
    if len(got[1]) != len(want[1]):
        extra = sorted(set(got[1]) - set(want[1]))[:2]
        lost = sorted(set(want[1]) - set(got[1]))[:2]
        return "FAIL", f"{len(got[1])} != {len(want[1])} rows\n  spark {str(extra)[:600]}\n  duck  {str(lost)[:600]}", spark_time, duck_time
    bad = [(g, w) for g, w in zip(got[1], want[1]) if g != w]
    near = all(all(close(a, b) for a, b in zip(g, w)) for g, w in bad)
    g, w = bad[0]
    diff = [(c, a[:300], b[:300]) for c, a, b in zip(got[0], g, w) if a != b]
    return ("NEAR" if near else "FAIL"), f"{len(bad)} of {len(got[1])} rows differ: {diff}\n   row {str(g)[:300]}", spark_time, duck_time


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    sys.path.insert(0, ".")
    from __spark_entry__ import oracle_sql, queries

    folder = f"/root/testdata/sf{args.sf}"
    all_queries, oracles = queries(), oracle_sql()
    names = [n for n in all_queries if not args.names or any(n.startswith(a) for a in args.names)]
    spark = session()
    failed = 0
    for name in names:
        try:
            status, note, a, b = compare(spark, folder, name, all_queries[name], oracles.get(name))
        except Exception as error:  # report and go on with the next query
            status, note, a, b = "ERROR", str(error)[:900], 0.0, 0.0
            if len(names) < 4:
                traceback.print_exc()
        failed += status not in ("ok", "rows")
        print(f"{status:6} {name:26} spark {a:6.2f}s duck {b:6.2f}s  {note}", flush=True)
    print(f"{len(names)} queries, {failed} not ok")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
