"""Every registered query with a SQL twin gives the same table in Spark and DuckDB."""

import duckdb
import numpy as np
import pytest

from __spark_entry__ import oracle_sql, queries

FOLDER = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    return connection


def canonical(df):
    df = df[sorted(df.columns)]

    def text(x):
        if x is None or (isinstance(x, float) and np.isnan(x)):
            return "null"
        return repr(x.item() if hasattr(x, "item") else x)

    return sorted(zip(*[df[c].map(text) for c in df.columns]))


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_matches_sql(spark, duck, name):
    mine = queries()[name](spark, FOLDER).toPandas()
    theirs = duck.execute(oracle_sql()[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert canonical(mine) == canonical(theirs)


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())
