"""Runs a query in Spark and its SQL in DuckDB, and compares the rows."""

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return con


def normal(df):
    def one(v):
        if v is None or (not hasattr(v, "__len__") and pd.isna(v)):
            return "null"
        return repr(round(v, 6)) if isinstance(v, float) else str(v)

    df = df[sorted(df.columns)].map(one)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def same(spark_df, con, sql):
    a, b = normal(spark_df.toPandas()), normal(con.execute(sql).df())
    assert list(a.columns) == list(b.columns)
    assert len(a) == len(b)
    assert a.equals(b), a[(a != b).any(axis=1)].head().to_string() + "\n" + b[(a != b).any(axis=1)].head().to_string()
