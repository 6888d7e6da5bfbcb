"""Differential: every registered query against its DuckDB oracle at sf0.01."""

import pytest

from calibra.oracle import ORACLE
from calibra.registry import QUERIES

from conftest import SF01
from oracle_check import compare, duck


@pytest.fixture(scope="module")
def con():
    return duck(SF01)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    n, problems = compare(spark, con, name, QUERIES[name], ORACLE[name], SF01)
    assert not problems, problems
