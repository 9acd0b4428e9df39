"""Every registered query agrees with its SQL."""

from __future__ import annotations

import pytest

from __spark_entry__ import entry
from fleetlens.catalog import ORACLES, QUERIES
from tests.check_oracles import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    verdict, _, _ = compare(spark, con, SF, name, QUERIES[name], ORACLES.get(name))
    assert verdict in ("ok", "rows-only"), verdict


def test_entry_has_rows(spark):
    assert entry(spark).count() > 0


def test_only_the_regression_has_no_sql():
    assert set(QUERIES) - set(ORACLES) == {"w11_lag_regression"}
