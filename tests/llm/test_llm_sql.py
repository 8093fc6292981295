"""Queries of the training-data operators that SQL can express, against DuckDB."""

import pytest
from oracle import SMALL, same

from loglathe.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query(spark, name):
    assert same(queries.QUERIES[name](spark, SMALL), queries.ORACLE[name]) > 0


def test_all_operators():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
