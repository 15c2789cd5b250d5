"""Queries of the training-data operators against their SQL."""

import os
import sys

import pytest

from tideline.llm.queries import ORACLES, QUERIES

sys.path.insert(0, os.path.dirname(os.path.dirname(__file__)))
from oracle import assert_same  # noqa: E402


def test_ten_queries():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    assert_same(spark, QUERIES[name], ORACLES[name], "/root/testdata/sf0.001")
