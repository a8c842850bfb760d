"""Comparing a query's rows with those of its SQL."""

import os

import duckdb
import pandas as pd

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(x):
    if hasattr(x, "tolist"):
        x = x.tolist()
    if isinstance(x, (list, tuple)):
        return str([canonical(y) for y in x])
    if x is None or x is pd.NaT or isinstance(x, float) and x != x:
        return "null"
    if isinstance(x, bool):
        return str(x)
    return f"{x:.9g}" if isinstance(x, (int, float)) else str(x)


def rows(df: pd.DataFrame) -> list:
    columns = sorted(df.columns)
    return sorted(zip(*[[canonical(x) for x in df[c]] for c in columns], strict=True))


def duck(sql: str) -> pd.DataFrame:
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return connection.sql(sql).df()


def assert_same(query, sql: str, spark) -> None:
    a, b = query(spark, DATA).toPandas(), duck(sql)
    assert sorted(a.columns) == sorted(b.columns)
    for c in a.columns:
        if pd.api.types.is_numeric_dtype(a[c]) and not pd.api.types.is_bool_dtype(a[c]):
            a[c], b[c] = a[c].astype(float), b[c].astype(float)
    assert rows(a) == rows(b)
