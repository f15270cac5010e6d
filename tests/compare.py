"""A query's rows against its SQL, column order and row order aside."""

import glob
import math
import os

import duckdb
import pandas as pd


def tidy(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return None if math.isnan(v) else float(v)
    return str(v)


def rows_of(df):
    cols = sorted(df.columns)
    return sorted(([tidy(v) for v in r] for r in df[cols].itertuples(index=False)), key=str)


def assert_same(spark, d, query, sql):
    c = duckdb.connect()
    for p in glob.glob(f"{d}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    got, want = query(spark, d).toPandas(), c.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)
