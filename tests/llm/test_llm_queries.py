"""The text queries run on the smallest tables; those with an oracle agree with it."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import oracle  # noqa: E402

from kgspark.llm import queries  # noqa: E402


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, data, name):
    oracle.compare(queries.QUERIES[name](spark, data), oracle.connect(data), queries.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_runs(spark, data, name):
    df = queries.QUERIES[name](spark, data)
    assert df.columns and df.count() >= 0
