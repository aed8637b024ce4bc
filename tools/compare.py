"""Run registered queries in Spark and DuckDB over one data folder and compare the rows.

    python tools/compare.py /root/testdata/sf0.01 [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import tempfile
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from checks import REGISTRY  # noqa: E402
from gridloom.session import build_session  # noqa: E402


def canonical(value):
    if value is None or isinstance(value, (bool, str)):
        return value
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    if isinstance(value, (list, tuple)):
        return tuple(canonical(v) for v in value)
    return float(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(canonical(r[i]) for i in order) for r in rows)


def main() -> int:
    sf, names = sys.argv[1], sys.argv[2:] or list(REGISTRY)
    spark = build_session(
        "compare",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.driver.memory": "8g",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="gridloom-checkpoints-"),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for f in sorted(os.listdir(sf)):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    bad = 0
    for name in names:
        q = REGISTRY[name]
        try:
            start = time.time()
            df = q.run(spark, sf)
            got = rows_of(df.columns, df.collect())
            took = time.time() - start
            if q.sql is None:
                print(f"rows   {name}: {sum(got.values())} in {took:.1f}s", flush=True)
                continue
            start = time.time()
            cur = con.execute(q.sql)
            columns = [d[0] for d in cur.description]
            want = rows_of(columns, cur.fetchall())
            sql_took = time.time() - start
            if sorted(columns) != sorted(df.columns):
                raise AssertionError(f"columns {sorted(df.columns)} vs {sorted(columns)}")
            if got != want:
                a, b = list((got - want).elements())[:3], list((want - got).elements())[:3]
                raise AssertionError(f"{sum(got.values())} vs {sum(want.values())} rows\n  spark {a}\n  duck  {b}")
            print(f"ok     {name}: {sum(got.values())} in {took:.1f}s (sql {sql_took:.1f}s)", flush=True)
        except Exception as e:
            bad += 1
            print(f"FAILED {name}: {type(e).__name__}: {str(e)[:600]}", flush=True)
    print(f"{len(names) - bad} of {len(names)} good")
    return bad


if __name__ == "__main__":
    sys.exit(main())
