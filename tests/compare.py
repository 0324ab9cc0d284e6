"""Compare a query with its DuckDB SQL on the same tables."""

import math

import duckdb

from seqspark.plans.catalog import TABLES


def connection(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v


def assert_same(df, con, sql):
    columns = sorted(df.columns)
    relation = con.sql(sql)
    assert sorted(relation.columns) == columns
    place = [relation.columns.index(c) for c in columns]
    want = sorted((tuple(_plain(r[i]) for i in place) for r in relation.fetchall()), key=repr)
    got = sorted((tuple(_plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert got == want
