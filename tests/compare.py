"""Run registered queries next to their SQL twins: python tests/compare.py SF_DIR [name ...]."""

from __future__ import annotations

import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, name, query, sql, folder):
    """None when equal, else a description of the difference."""
    df = query(spark, folder)
    got = df.collect()
    if sql is None:
        return None if got else "no rows"
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    want = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if a == b:
        return None if a else "no rows on either side"
    extra, lost = sorted(set(a) - set(b))[:3], sorted(set(b) - set(a))[:3]
    return f"{len(a)} rows != {len(b)} rows; only spark {extra}; only sql {lost}"


def session():
    from pyspark.sql import SparkSession

    return (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


if __name__ == "__main__":
    import __spark_entry__ as entry

    folder = sys.argv[1]
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    queries, oracle = entry.queries(), entry.oracle_sql()
    wanted = sys.argv[2:] or list(queries)
    bad = 0
    for name in wanted:
        t = time.time()
        try:
            problem = compare(spark, con, name, queries[name], oracle.get(name), folder)
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:1500]}"
        bad += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {time.time() - t:6.2f}s {'sql ' if name in oracle else 'rows'} {name} {problem or ''}", flush=True)
    print(f"{len(wanted) - bad} of {len(wanted)} match")
    spark.stop()
