"""Queries that SQL can express, against that SQL."""

from __future__ import annotations

import pytest

from skein.llm.queries import ORACLE, QUERIES
from tests.conftest import TESTDATA
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, name):
    sf_dir = f"{TESTDATA}/sf0.01"
    compare(QUERIES[name](spark, sf_dir), ORACLE[name], sf_dir)


def test_one_query_for_each_operator():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 11)}
