"""Compares a DataFrame with the rows that DuckDB gives for its SQL."""

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def text(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
        return ""
    if isinstance(v, float):
        return f"{v:.9g}"
    return str(list(v)) if hasattr(v, "__len__") and not isinstance(v, str) else str(v)


def same(df, sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    got, want = df.toPandas(), con.sql(sql).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = lambda t: sorted(tuple(text(v) for v in r) for r in t[cols].itertuples(index=False))
    assert rows(got) == rows(want)
