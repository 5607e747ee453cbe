"""Holds a Spark query against its SQL twin as the driver does."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


def rows_of(df):
    def plain(x):
        if x is None or x is pd.NaT or (isinstance(x, float) and x != x):
            return None
        if isinstance(x, bool):
            return x
        return round(float(x), 6) if isinstance(x, (int, float)) or hasattr(x, "dtype") else str(x)

    df = df[sorted(df.columns)]
    return sorted((tuple(plain(x) for x in r) for r in df.itertuples(index=False)), key=repr)


def compare(query, sql, spark, folder):
    got, want = query(spark, folder).toPandas(), connect(folder).sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)
