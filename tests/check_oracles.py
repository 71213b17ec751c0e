"""Compare registered queries with their oracle SQL: python tests/check_oracles.py [sf_dir] [name ...]"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb
import numpy as np
import pandas as pd
from pyspark.sql import SparkSession

import __spark_entry__ as E

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def session(cpus: str = "8") -> SparkSession:
    return (SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", "8")
            .config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
            .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate())


def oracle_connection(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def kind(v: pd.Series) -> str:
    if v.dtype == bool:
        return "bool"
    if np.issubdtype(v.dtype, np.number):
        return "number"
    return "other"


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype.kind == "M" or (len(df) and hasattr(df[c].dropna().iloc[:1].squeeze(), "isoformat")):
            df[c] = pd.to_datetime(df[c]).dt.strftime("%Y-%m-%d")
        elif df[c].dtype.kind in "iuf":
            df[c] = df[c].astype(float)
    order = [c for c in df.columns]
    return df.sort_values(order, na_position="first", key=lambda s: s.astype(str) if s.dtype == object else s).reset_index(drop=True)


def compare(spark_df: pd.DataFrame, sql_df: pd.DataFrame) -> str:
    if sorted(spark_df.columns) != sorted(sql_df.columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(sql_df.columns)}"
    if len(spark_df) != len(sql_df):
        return f"rows {len(spark_df)} != {len(sql_df)}"
    a, b = canonical(spark_df), canonical(sql_df)
    bad = []
    for c in a.columns:
        same = (a[c] == b[c]) | (a[c].isna() & b[c].isna())
        if not same.all():
            i = int(np.argmin(same.to_numpy()))
            bad.append(f"{c}: {int((~same).sum())} differ, e.g. {a[c].iloc[i]!r} vs {b[c].iloc[i]!r}")
    return "; ".join(bad)


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark, con = session(), oracle_connection(sf_dir)
    spark.sparkContext.setLogLevel("ERROR")
    sql, failed = E.oracle_sql(), 0
    for name, run in E.queries().items():
        if names and name not in names:
            continue
        t0 = time.time()
        try:
            got = run(spark, sf_dir).toPandas()
            t1 = time.time()
            if name in sql:
                want = con.execute(sql[name]).df()
                problem = compare(got, want)
            else:
                problem, want = "" if len(got) else "no rows", got
        except Exception as exc:  # noqa: BLE001
            problem, t1, got = f"{type(exc).__name__}: {str(exc)[:600]}", time.time(), []
        failed += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {name:34s} rows {len(got):7d} spark {t1 - t0:6.2f}s sql {time.time() - t1:6.2f}s {problem}",
              flush=True)
    print(f"{failed} failed")


if __name__ == "__main__":
    main()
