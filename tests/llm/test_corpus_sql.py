"""Corpus queries that SQL can express, on the smallest tables."""

import pytest
from parity import compare, connect

from lamina.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, sf_dir, name):
    assert compare(spark, connect(sf_dir), sf_dir, name, QUERIES[name], ORACLES[name]) is None
