"""Run registered queries against their SQL in DuckDB: ``python tests/compare.py FOLDER [name ...]``."""

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

SMALL = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9) + 0.0
    return value


def sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    out = [tuple(plain(row[i]) for i in order) for row in rows]
    return names, sorted(out, key=lambda row: tuple((v is None, str(v)) for v in row))


def duck(folder):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def difference(df, con, sql):
    """None if both give the same rows, else what differs. Also compares the Python types of the values."""
    left = sorted_rows(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    right = sorted_rows([c[0] for c in result.description], result.fetchall())
    if left[0] != right[0]:
        return f"columns {left[0]} != {right[0]}"
    if len(left[1]) != len(right[1]):
        return f"rows {len(left[1])} != {len(right[1])}"
    if left[1] != right[1]:
        wrong = [(a, b) for a, b in zip(left[1], right[1]) if a != b]
        return f"{len(wrong)} rows differ, first {left[0]}: {wrong[0]}"
    for i, name in enumerate(left[0]):
        kinds = {(type(a[i]), type(b[i])) for a, b in zip(left[1], right[1])}
        if any(a is not b for a, b in kinds):
            return f"types of {name}: {kinds}"
    return None


def session(slice_rows=None):
    from pyspark.sql import SparkSession

    builder = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    if slice_rows:
        spark.conf.set("spark.cardwatch.sliceRows", str(slice_rows))
    return spark


if __name__ == "__main__":
    import __spark_entry__ as entry

    folder, names = sys.argv[1], sys.argv[2:]
    spark = session(os.environ.get("SLICE_ROWS"))
    con = duck(folder)
    oracles = entry.oracle_sql()
    failed = 0
    for name, fn in entry.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            if name in oracles:
                problem = difference(fn(spark, folder), con, oracles[name])
            else:
                problem = None if fn(spark, folder).count() > 0 else "no rows"
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failed += problem is not None
        print(f"{name:45s} {time.time() - start:6.2f}s {'ok' if problem is None else problem}", flush=True)
    print("failed", failed)
