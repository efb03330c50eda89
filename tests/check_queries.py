"""Run every query next to its SQL on one scale: python tests/check_queries.py DIR [names]."""

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry  # noqa: E402
from saddlespark.session import build_session  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cells(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    def key(v):
        return repr(float(v)) if isinstance(v, float) else repr(v)
    return sorted(tuple(key(r[i]) for i in order) for r in rows)


def compare(spark, con, name, sf):
    t = time.time()
    df = entry.queries()[name](spark, sf)
    got = cells([tuple(r) for r in df.collect()], df.columns)
    spent = time.time() - t
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return f"rows only ({len(got)})", spent
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    want = cells(res.fetchall(), names)
    if sorted(names) != sorted(df.columns):
        return f"COLUMNS {sorted(df.columns)} {sorted(names)}", spent
    if got != want:
        diff = [(a, b) for a, b in zip(got, want) if a != b][:2]
        return f"DIFFERENT {len(got)} {len(want)} {diff}", spent
    return f"ok ({len(got)})", spent


def connect(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


if __name__ == "__main__":
    sf = sys.argv[1]
    names = sys.argv[2:] or list(entry.queries())
    spark = build_session("check", "local[8]", **{"spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.sql.shuffle.partitions": "8"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    for n in names:
        try:
            print(n, *compare(spark, con, n, sf), flush=True)
        except Exception as e:  # noqa: BLE001
            print(n, "FAILED", str(e)[:600], flush=True)
