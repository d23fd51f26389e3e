"""Runs queries in Spark and in DuckDB over the same tables: python tests/compare.py SF_DIR [NAME ...]"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd


def views(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return con


def canonical(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    return sorted((tuple("null" if v is None or v is pd.NA or v != v else f"{v:.9g}" if isinstance(v, float) else str(int(v)) if isinstance(v, (bool, int)) or type(v).__name__.startswith(("int", "bool")) else str(v) for v in row) for row in df.itertuples(index=False)))


def differences(spark, con, sf_dir: str, query, sql: str) -> str:
    """Empty where both results are equal."""
    a, b = query(spark, sf_dir).toPandas(), con.execute(sql).df()
    if sorted(a.columns) != sorted(b.columns):
        return f"columns {sorted(a.columns)} and {sorted(b.columns)}"
    x, y = canonical(a), canonical(b)
    if x == y:
        return ""
    bad = [(p, q) for p, q in zip(x, y) if p != q][:2]
    return f"{len(x)} and {len(y)} rows; {bad}"


def main(sf_dir: str, *names: str) -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con, oracle, bad = views(sf_dir), entry.oracle_sql(), 0
    for name, q in entry.queries().items():
        if names and name not in names or not names and name not in oracle:
            continue
        t = time.time()
        try:
            d = differences(spark, con, sf_dir, q, oracle[name])
        except Exception as e:  # the report goes on with the next query
            d = f"{type(e).__name__}: {str(e)[:700]}"
        bad += bool(d)
        print(f"{name}: {'same' if not d else d} ({time.time() - t:.1f} s)", flush=True)
    return bad


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    sys.exit(main(*sys.argv[1:]))
