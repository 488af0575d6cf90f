"""Run registered queries in Spark and DuckDB side by side and compare the rows.

    python -m checks.compare [SF_DIR] [QUERY ...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

from checks.oracle import ORACLES
from checks.queries import QUERIES

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def _plain(value):
    if value is None or value is pd.NA or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, (int, float)) and not isinstance(value, bool) and float(value).is_integer():
        return str(int(value))
    return str(value)


def rows_of(frame) -> list[tuple]:
    columns = sorted(frame.columns)
    return sorted((tuple(_plain(v) for v in row) for row in frame[columns].itertuples(index=False)),
                  key=lambda r: tuple((v is not None, v or "") for v in r))


def main(sf_dir: str, names: list[str]) -> int:
    spark = (SparkSession.builder.master("local[8]").config("spark.driver.memory", "12g")
             .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").getOrCreate())
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf_dir)
    failures = 0
    for name in names or list(QUERIES):
        try:
            start = time.time()
            mine = QUERIES[name](spark, sf_dir).toPandas()
            spent = time.time() - start
            if name not in ORACLES:
                print(f"{name:24} rows only {len(mine):8} {spent:6.1f}s", flush=True)
                continue
            start = time.time()
            theirs = con.sql(ORACLES[name]).df()
            duck = time.time() - start
            a, b = rows_of(mine), rows_of(theirs)
            same = a == b and sorted(mine.columns) == sorted(theirs.columns)
            print(f"{name:24} {'same' if same else 'DIFFERENT'} {len(a):8} {len(b):8} {spent:6.1f}s {duck:6.1f}s", flush=True)
            if not same:
                failures += 1
                left, right = set(a), set(b)
                print("  columns", sorted(mine.columns), sorted(theirs.columns))
                for row in sorted(left - right, key=str)[:3]:
                    print("  spark ", row)
                for row in sorted(right - left, key=str)[:3]:
                    print("  duckdb", row)
        except Exception as problem:  # noqa: BLE001 - report and go on with the next query
            failures += 1
            print(f"{name:24} FAILED {type(problem).__name__}: {str(problem)[:600]}", flush=True)
    return failures


if __name__ == "__main__":
    args = sys.argv[1:]
    folder = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    sys.exit(1 if main(folder, args) else 0)
