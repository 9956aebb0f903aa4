"""Spark results against DuckDB's, as sorted rows of rounded values."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    db = duckdb.connect()
    for name in TABLES:
        db.sql(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return db


def rows(frame):
    frame = frame[sorted(frame.columns)]
    shown = lambda x: "NULL" if pd.isna(x) else f"{x:.9g}" if isinstance(x, float) else str(x)
    return sorted(tuple(map(shown, r)) for r in frame.itertuples(index=False))


def assert_same(spark_frame, db, sql):
    got, want = spark_frame.toPandas(), db.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
