"""Runs queries and their SQL side by side: python tests/compare.py SF_DIR [NAME ...]"""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in sorted(os.listdir(sf_dir)):
        if name.endswith(".parquet"):
            path = f"{sf_dir}/{name}" + ("/*.parquet" if os.path.isdir(f"{sf_dir}/{name}") else "")
            con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    return con


def plain(rows: list[tuple]) -> list[tuple]:
    def one(x):
        if isinstance(x, bool) or x is None or isinstance(x, str):
            return x
        if isinstance(x, (list, tuple, dict)):
            return str(x)
        return round(float(x), 6) + 0.0

    return sorted((tuple(map(one, r)) for r in rows), key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def differences(df, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """'' if a DataFrame and a SQL text give the same rows."""
    expected = con.sql(sql)
    names = sorted(df.columns)
    if names != sorted(expected.columns):
        return f"columns {names} against {sorted(expected.columns)}"
    got = plain([tuple(r) for r in df.select(*names).collect()])
    want = plain(expected.select(*[f'"{n}"' for n in names]).fetchall())
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}"
    return next((f"{g} against {w}" for g, w in zip(got, want, strict=True) if g != w), "")


def main(sf_dir: str, names: list[str]) -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connection(sf_dir), 0
    for name in names or list(entry.queries()):
        started = time.time()
        try:
            df = entry.queries()[name](spark, sf_dir)
            sql = entry.oracle_sql().get(name)
            said = differences(df, con, sql) if sql else f"rows only: {df.count()}"
        except Exception as e:  # reported below
            said = f"{type(e).__name__}: {str(e)[:400]}"
        ok = not said or said.startswith("rows only")
        bad += not ok
        print(f"{'ok' if ok else 'BAD'} {name} {time.time() - started:.1f}s {said}", flush=True)
    return bad


if __name__ == "__main__":
    pd.set_option("display.width", 200)
    sys.exit(main(sys.argv[1], sys.argv[2:]))
