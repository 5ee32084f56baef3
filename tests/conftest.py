from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from ledgerlane import schemas as S  # noqa: E402
from ledgerlane.session import local_session  # noqa: E402
from ledgerlane.sources import lifecycle as L  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(
        "tests",
        spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")),
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")),
        spark__sql__shuffle__partitions="4",
    )
    yield session
    session.stop()


@pytest.fixture(scope="session")
def raw_by_profile(spark):
    orders = spark.read.parquet(f"{SF_DIR}/orders.parquet")
    return {p: L.raw_tables(orders, p) for p in (L.MESSY, L.CLEAN)}


@pytest.fixture
def tables(spark):
    """Raw tables from a few rows: orders (id, customer, created, amount, status), events."""

    def build(orders=(), events=()):
        order_rows = [(o, c, t, a, "EUR", s) for o, c, t, a, s in orders]
        event_rows = [(e, o, k, t, "backend") for e, o, k, t in events]
        return {
            S.ORDERS: spark.createDataFrame(order_rows, S.RAW_ORDERS),
            S.ORDER_EVENTS: spark.createDataFrame(event_rows, S.RAW_ORDER_EVENTS),
        }

    return build
