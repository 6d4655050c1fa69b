"""The numbered queries with SQL, against DuckDB at the smallest scale."""

import pytest

from corpusmill.llm import registry

from ..oracle import same

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query(spark, name):
    same(registry.QUERIES[name](spark, DIR), registry.ORACLE_SQL[name], DIR)
