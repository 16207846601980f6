"""Compare registered queries with their SQL twins in DuckDB.

Run as a script: python tests/compare.py [folder] [query ...]
"""

import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def plain(value):
    if value is None:
        return ("", "null")
    if isinstance(value, bool):
        return ("b", str(value))
    if isinstance(value, float) and math.isnan(value):
        return ("n", "nan")
    if isinstance(value, (int, float)):
        return ("n", repr(float(value) + 0.0))
    return ("s", str(value))


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(row[i]) for i in order) for row in rows)


def differences(con, sql, df):
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(names)} and {sorted(df.columns)}"
    expected = rows_of(names, cursor.fetchall())
    actual = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if len(expected) != len(actual):
        return f"{len(expected)} and {len(actual)} rows"
    wrong = [(e, a) for e, a in zip(expected, actual) if e != a]
    return f"{len(wrong)} rows differ, first {wrong[0]}" if wrong else None


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    chosen = sys.argv[2:] or list(entry.queries())
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    for name in chosen:
        start = time.time()
        try:
            df = entry.queries()[name](spark, folder)
            sql = entry.oracle_sql().get(name)
            if sql is None:
                problem, note = None, f"rows only: {df.count()}"
            else:
                problem, note = differences(con, sql, df), "equal"
        except Exception as error:  # keep going over the other queries
            problem, note = f"{type(error).__name__}: {str(error)[:600]}", ""
        bad += problem is not None
        print(f"{name:32s} {time.time() - start:6.2f}s  {problem or note}", flush=True)
    print(f"{len(chosen)} queries, {bad} problems")
