"""Every registered query of the log engine against DuckDB on the smallest tables."""

import pytest
from oracle import SMALL, same

import __spark_entry__
from loglathe.plans import queries


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() > 0
    assert set(df.columns) == {"endpoint", "resource", "requests", "errors", "total_ms", "max_ms"}


def test_registry():
    assert set(queries.ORACLE) <= set(queries.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query(spark, name):
    assert same(queries.QUERIES[name](spark, SMALL), queries.ORACLE[name]) > 0


def test_generated_repeats(spark):
    one, two = (sorted(map(tuple, queries.QUERIES["generated"](spark, SMALL).collect())) for _ in range(2))
    assert one == two and len(one) == spark.read.parquet(f"{SMALL}/events.parquet").count()
