"""Every registered query beside its SQL text on the smallest data set."""

import duckdb
import pytest

import __spark_entry__ as entry_point
from check import TABLES, table
from tests.conftest import SMALL

QUERIES = entry_point.queries()
ORACLES = entry_point.oracle_sql()


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{SMALL}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SMALL)
    got = table(df.columns, [tuple(r) for r in df.collect()])
    assert got[1], "no rows"
    if name in ORACLES:
        cursor = con.execute(ORACLES[name])
        assert got == table([d[0] for d in cursor.description], cursor.fetchall())


def test_entry(spark):
    df = entry_point.entry(spark)
    assert df.count() > 0
    assert df.columns == [
        "tenant_id", "total_chats", "unique_visitors", "embedding_token_usage", "chat_token_usage",
        "likes", "dislikes", "rating_count", "average_rating",
    ]


def test_every_oracle_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)
