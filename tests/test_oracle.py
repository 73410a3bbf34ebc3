"""Every query of the library against its SQL on the smallest tables."""

from __future__ import annotations

import pytest

from corpuswright.plans import catalogue

from .util import connect, same

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    same(catalogue.queries()[name](spark, SF), con, catalogue.oracle_sql()[name])


def test_every_query_runs_without_sql(spark):
    for name in set(catalogue.queries()) - set(catalogue.oracle_sql()):
        assert catalogue.queries()[name](spark, SF).count() >= 0
