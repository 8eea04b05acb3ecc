"""Every registered query against its oracle on the smallest test set."""

from __future__ import annotations

import pytest

from quayside.plans import registry
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, connection, name):
    assert compare(spark, connection, registry.queries()[name], registry.oracle_sql()[name], SF) == ""


def test_no_oracle_without_query():
    assert registry.oracle_sql().keys() <= registry.queries().keys()


def test_entry(spark):
    import __spark_entry__ as entry

    plan = entry.entry(spark)
    assert plan.columns == ["warehouse_id", "sku", "unit_of_measure", "expected_units", "shipment_lines"]
    assert plan.count() > 0
    assert entry.queries().keys() >= registry.queries().keys()
