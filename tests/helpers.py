"""Comparing Spark and DuckDB results, and evaluating column functions on plain values."""

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = Path("/root/testdata/sf0.001")


def plain(value):
    if hasattr(value, "item"):
        value = value.item()
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    return repr(round(value, 6)) if isinstance(value, float) else str(value)


def spark_rows(df):
    columns = sorted(df.columns)
    return columns, sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)


def duck_rows(sql, data=DATA):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    found = con.sql(sql)
    columns = sorted(found.columns)
    at = [found.columns.index(c) for c in columns]
    return columns, sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=repr)


def values(spark, rows, schema, **columns):
    """Rows of dicts: the named column expressions over inline rows."""
    df = spark.createDataFrame(rows, schema)
    return [r.asDict(recursive=True) for r in df.select(*(v.alias(k) for k, v in columns.items())).collect()]
