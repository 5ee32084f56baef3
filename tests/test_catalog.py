"""Every registered query against its SQL twin."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry_points
from ledgerlane.catalog.oracle import all_oracles
from ledgerlane.catalog.queries import all_queries
from tests.compare import difference, duck
from tests.conftest import SF_DIR


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


def test_every_query_has_a_twin():
    assert set(all_queries()) == set(all_oracles())


@pytest.mark.parametrize("name", list(all_queries()))
def test_query_agrees_with_its_twin(spark, con, name):
    assert difference(spark, con, SF_DIR, name) is None


def test_entry(spark):
    assert entry_points.entry(spark).first()["orders_total"] == 1505
