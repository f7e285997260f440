"""Every registered query against its SQL restatement."""

import os

import pytest

import __spark_entry__ as entry_points
import oracle
from codeloom.plans.oracles import ORACLES
from codeloom.plans.queries import QUERIES

SF_DIR = os.environ.get("CODELOOM_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    return oracle.connect(SF_DIR)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_entry_has_rows(spark):
    assert entry_points.entry(spark).count() > 0


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    result = QUERIES[name](spark, SF_DIR)
    assert oracle.difference(result, duck, ORACLES[name]) is None
