"""Run registered queries on Spark and their SQL twins on DuckDB; report rows, columns, values, seconds.

usage: python tools/compare.py SF_DIR [name or name-prefix ...]
"""

from __future__ import annotations

import os
import sys
import time
import traceback

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def session():
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if v != v else repr(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    return str(v)


def rowset(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in rows)


def check(spark, con, fn, sql, sf_dir):
    df = fn(spark, sf_dir)
    cols = df.columns
    rows = [tuple(r) for r in df.collect()]
    if sql is None:
        return len(rows), "rows-only", cols, []
    cur = con.execute(sql)
    ocols = [x[0] for x in cur.description]
    orows = cur.fetchall()
    if sorted(cols) != sorted(ocols):
        return len(rows), f"COLUMNS differ {sorted(cols)} vs {sorted(ocols)}", cols, []
    a, b = rowset(cols, rows), rowset(ocols, orows)
    if a == b:
        return len(rows), "ok", cols, []
    only_a = sorted(set(a) - set(b))[:4]
    only_b = sorted(set(b) - set(a))[:4]
    return len(rows), f"DIFF rows {len(a)} vs {len(b)}, unmatched {len(set(a) - set(b))}", sorted(cols), [only_a, only_b]


def main():
    from windrow.catalog import ORACLES, QUERIES

    sf_dir, picks = sys.argv[1], sys.argv[2:]
    spark, con = session(), connect(sf_dir)
    bad = 0
    for name, fn in QUERIES.items():
        if picks and not any(name == p or (p.endswith("*") and name.startswith(p[:-1])) or fn.__module__.endswith(p) for p in picks):
            continue
        t = time.time()
        try:
            n, res, cols, diff = check(spark, con, fn, ORACLES.get(name), sf_dir)
        except Exception as e:  # noqa: BLE001
            n, res, cols, diff = -1, "ERROR " + str(e).split("JVM stacktrace")[0][:600], [], []
            if os.environ.get("TRACE"):
                traceback.print_exc()
        flag = "" if res in ("ok", "rows-only") and n > 0 else "  <<<<"
        bad += bool(flag)
        print(f"{name:26s} rows={n:<8d} {time.time() - t:6.2f}s {res}{flag}", flush=True)
        if diff:
            print("   cols ", cols)
            for side, rows in zip(("spark", "sql  "), diff):
                for r in rows:
                    print("   ", side, r)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
