"""Runs queries in Spark and their SQL in DuckDB on the same tables and compares the rows.

python -m tests.oracle SF_DIR NAME... (all if none is given)
"""

from __future__ import annotations

import datetime
import glob
import math
import os
import sys
import time
from collections import Counter


def tidy(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}") + 0.0
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return list(map(tidy, v)) if isinstance(v, (list, tuple)) else v


def database(sf_dir: str):
    import duckdb

    c = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        at = p if os.path.isfile(p) else f"{p}/*.parquet"
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{at}')")
    return c


def compare(spark, con, sf_dir: str, f, sql: str | None) -> str:
    df = f(spark, sf_dir)
    cols = sorted(df.columns)
    got = Counter(repr([tidy(r[c]) for c in cols]) for r in df.collect())
    if sql is None:
        return f"rows {sum(got.values())} (no SQL)"
    r = con.execute(sql)
    names = [d[0] for d in r.description]
    if sorted(names) != cols:
        return f"BAD columns {cols} against {sorted(names)}"
    order = [names.index(c) for c in cols]
    want = Counter(repr([tidy(x[i]) for i in order]) for x in r.fetchall())
    if got == want:
        return f"ok {sum(got.values())}"
    return f"BAD spark {sum(got.values())} sql {sum(want.values())} both {sum((got & want).values())}: only spark {list((got - want))[:2]} only sql {list((want - got))[:2]} {cols}"


def main(args: list[str]) -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    sf_dir, names = args[0], args[1:]
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = database(sf_dir), 0
    qs, sql = e.queries(), e.oracle_sql()
    for n in names or qs:
        t = time.time()
        try:
            said = compare(spark, con, sf_dir, qs[n], sql.get(n))
        except Exception as x:
            said = "BAD " + str(x)[:1500]
        bad += said.startswith("BAD")
        print(f"{n}: {said} ({time.time() - t:.1f} s)", flush=True)
    print("bad", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
