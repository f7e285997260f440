"""Queries that have SQL, against it."""

import pytest

import oracle
from codeloom.llm.oracles import ORACLES
from codeloom.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(ORACLES))
def test_query(spark, name):
    assert oracle.difference(QUERIES[name](spark, SF_DIR), oracle.connect(SF_DIR), ORACLES[name]) is None
