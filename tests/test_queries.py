"""Every registered query of the trace part against its SQL, at the smallest scale."""

import math

import duckdb
import pytest

import __spark_entry__
from kestrace.plans import catalogue

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    return f"{v:.6f}" if isinstance(v, float) else str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DIR)
    got = rows_of(df.columns, df.collect())
    if name not in catalogue.SQL:
        assert got
        return
    ran = duck.execute(catalogue.SQL[name])
    names = [c[0] for c in ran.description]
    assert sorted(names) == sorted(df.columns)
    assert got == rows_of(names, ran.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
