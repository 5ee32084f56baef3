"""Events before orders, against a plain pairwise count over small random tables."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from ledgerlane import schemas as S
from ledgerlane.operators import lookup as K
from ledgerlane.operators.sequence import conflict_counts, events_before_orders

TIMES = [
    "2024-01-01 00:00:00",
    "2024-01-01 00:00:00.000001",
    "2024-01-01 00:00:00.5",
    "2024-01-01 00:00:01",
    "2024-01-01 13:00:00",
    "2024-01-02 00:00:00",
    "2024-01-02 02:00:00+02:00",
    "2023-12-31 23:59:59",
    "2024-06-01 00:00:00",
    "not-a-date",
    None,
]
# The same instants as sortable numbers; the seventh equals the sixth.
RANK = dict(zip(TIMES, [1, 2, 3, 4, 5, 6, 6, 0, 7, None, None]))
KEYS = ["a", "b", "", None]


def random_tables(seed, tables):
    rng = random.Random(seed)
    orders = [
        (rng.choice(KEYS), "c", rng.choice(TIMES), 1.0, "completed") for _ in range(25)
    ]
    events = [
        (f"E{rng.randrange(12)}", rng.choice(KEYS), "order_shipped", rng.choice(TIMES))
        for _ in range(40)
    ]
    return orders, events, tables(orders, events)


def pairwise(orders, events) -> Counter:
    found = Counter()
    for event in events:
        later = sum(
            1
            for order in orders
            if order[0] == event[1]
            and RANK[order[2]] is not None
            and RANK[event[3]] is not None
            and RANK[event[3]] < RANK[order[2]]
        )
        if later:
            found[(*event, later)] += 1
    return found


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("hot", ["none", "some", "all"])
def test_counts_equal_the_pairwise_count(spark, tables, seed, hot):
    orders, events, raw = random_tables(seed, tables)
    listed = K.hot_frame(spark, {"none": [], "some": ["a", None], "all": KEYS}[hot], "order_id")
    result = events_before_orders(raw[S.ORDERS], raw[S.ORDER_EVENTS], hot=listed)
    ours = Counter(
        (r.event_id, r.order_id, r.event_type, r.event_timestamp, r.later_orders)
        for r in result.collect()
    )
    expected = pairwise(orders, events)
    assert ours == expected
    counted = conflict_counts(raw[S.ORDERS], raw[S.ORDER_EVENTS], hot=listed)
    total = sum(r.later_orders for r in counted.collect())
    assert total == sum(row[-1] * n for row, n in expected.items())


def test_copies_of_one_event_are_kept_and_counted_each(spark, tables):
    raw = tables(
        [("a", "c", "2024-01-02 00:00:00", 1.0, "completed")] * 3,
        [("E1", "a", "order_shipped", "2024-01-01 00:00:00")] * 5,
    )
    rows = events_before_orders(raw[S.ORDERS], raw[S.ORDER_EVENTS]).collect()
    assert [r.later_orders for r in rows] == [3] * 5
