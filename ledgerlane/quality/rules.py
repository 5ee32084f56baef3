"""Quality rules as declarations: what a rule checks, on which table, how severe it is.

A check turns the tables into the violating rows of one rule. Checks that look at one
row at a time are plain predicates, so that any number of them shares a single scan.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlane import schemas as S
from ledgerlane.functions import exprs as X
from ledgerlane.operators.lookup import (
    NULLABLE_KEY,
    hot_keys_of,
    lookup_join,
    with_nullable_key,
)
from ledgerlane.operators.sequence import conflict_counts, events_before_orders

Tables = Mapping[str, DataFrame]

# Rows kept per failing rule.
SAMPLE_ROWS = 50


@dataclass(frozen=True)
class Check:
    """Base of all checks; ``population`` is the condition on rows a failure rate refers to."""

    population: str = "true"

    def violations(self, tables: Tables, table: str) -> DataFrame:
        raise NotImplementedError


@dataclass(frozen=True)
class RowCheck(Check):
    """Rows satisfying a predicate, which must never be NULL."""

    predicate: Callable[[DataFrame], Column] = lambda df: F.lit(False)

    def violations(self, tables: Tables, table: str) -> DataFrame:
        return tables[table].filter(self.predicate(tables[table]))


@dataclass(frozen=True)
class DuplicateCheck(Check):
    """All rows sharing a key value; missing keys equal each other."""

    column: str = ""

    def repeated(self, tables: Tables, table: str) -> DataFrame:
        """Values with more than one row, and how many; combined before the shuffle."""
        keyed = with_nullable_key(tables[table], self.column)
        counts = keyed.groupBy(*NULLABLE_KEY).agg(F.count("*").alias("rows"))
        return counts.filter(F.col("rows") > 1)

    def violations(self, tables: Tables, table: str) -> DataFrame:
        keyed = with_nullable_key(tables[table], self.column)
        keys = self.repeated(tables, table).select(*NULLABLE_KEY)
        hot = hot_keys_of(tables, self.column, nullable=True)
        return lookup_join(keyed, keys, NULLABLE_KEY, "left_semi", hot).select(
            *tables[table].columns
        )


@dataclass(frozen=True)
class OrdersWithoutEvents(Check):
    """Orders whose key no event carries; a missing key has no events."""

    def violations(self, tables: Tables, table: str) -> DataFrame:
        keys = tables[S.ORDER_EVENTS].select("order_id").distinct()
        hot = hot_keys_of(tables, "order_id")
        return lookup_join(tables[S.ORDERS], keys, ["order_id"], "left_anti", hot)


@dataclass(frozen=True)
class EventsWithoutOrders(Check):
    """Events whose key no order carries; a missing key has no order."""

    def violations(self, tables: Tables, table: str) -> DataFrame:
        keys = tables[S.ORDERS].select("order_id").distinct()
        events = tables[S.ORDER_EVENTS]
        hot = hot_keys_of(tables, "order_id")
        orphans = lookup_join(events, keys, ["order_id"], "left_anti", hot)
        return orphans.select(*events.columns)


@dataclass(frozen=True)
class CompletedWithoutPayment(Check):
    """Keys of completed orders without a payment event, whatever its timestamp.

    Here a missing order key does match a payment event with a missing key.
    """

    def violations(self, tables: Tables, table: str) -> DataFrame:
        completed, paid = self._sides(tables)
        hot = hot_keys_of(tables, "order_id", nullable=True)
        unpaid = lookup_join(completed, paid.distinct(), NULLABLE_KEY, "left_anti", hot)
        return unpaid.select("order_id")

    @staticmethod
    def _sides(tables: Tables) -> tuple[DataFrame, DataFrame]:
        done = F.col("order_status") == S.COMPLETED
        payment = F.col("event_type") == S.PAYMENT_CONFIRMED
        completed = tables[S.ORDERS].filter(done).select("order_id")
        payments = tables[S.ORDER_EVENTS].filter(payment).select("order_id")
        return (
            with_nullable_key(completed, "order_id"),
            with_nullable_key(payments, "order_id").select(*NULLABLE_KEY),
        )


@dataclass(frozen=True)
class EventBeforeOrder(Check):
    """Events dated before an order of the same key.

    One violation per (event, order row) pair. Pairs are counted, never listed: a
    violating event appears once, with the number of its pairs in ``later_orders``.
    """

    def violations(self, tables: Tables, table: str) -> DataFrame:
        hot = hot_keys_of(tables, "order_id")
        return events_before_orders(tables[S.ORDERS], tables[S.ORDER_EVENTS], hot)

    def pair_counts(self, tables: Tables) -> DataFrame:
        """``later_orders`` without the events: the same sum for less."""
        hot = hot_keys_of(tables, "order_id")
        return conflict_counts(tables[S.ORDERS], tables[S.ORDER_EVENTS], hot)


@dataclass(frozen=True)
class Rule:
    """One named check, with the columns its sample keys and sample rows show."""

    rule_id: str
    rule_name: str
    table_name: str
    severity: str
    check: Check
    key_columns: tuple[str, ...]
    sample_columns: tuple[str, ...]
    fallback_keys: tuple[str, ...] = ()

    def violations(self, tables: Tables) -> DataFrame:
        return self.check.violations(tables, self.table_name)

    def keys_in(self, df: DataFrame) -> tuple[str, ...]:
        """Sample-key columns; a table without them shows the fallback."""
        present = set(self.key_columns) <= set(df.columns)
        return self.key_columns if present else self.fallback_keys


# The rule names below are fixed values.
def duplicate_pk(
    table: str, pk: str, rule_id: str, severity: str, sample: Sequence[str]
) -> Rule:
    return Rule(
        rule_id,
        f"Duplicate primary key: {pk}",
        table,
        severity,
        DuplicateCheck(column=pk),
        (pk,),
        tuple(sample),
    )


def not_null(
    table: str,
    columns: Sequence[str],
    rule_id: str,
    severity: str,
    sample: Sequence[str],
) -> Rule:
    return Rule(
        rule_id,
        f"Missing required fields: {', '.join(columns)}",
        table,
        severity,
        RowCheck(predicate=lambda df: X.any_null(*columns)),
        ("order_id",),
        tuple(sample),
        (columns[0],),
    )


def allowed_values(
    table: str,
    column: str,
    allowed: Sequence[str],
    rule_id: str,
    severity: str,
    sample: Sequence[str],
) -> Rule:
    return Rule(
        rule_id,
        f"Invalid values in {column}",
        table,
        severity,
        RowCheck(predicate=lambda df: X.null_or_outside(column, tuple(allowed))),
        ("order_id",),
        tuple(sample),
        (column,),
    )


def amount_non_negative(rule_id: str, severity: str, sample: Sequence[str]) -> Rule:
    return Rule(
        rule_id,
        "Order amount must be >= 0",
        S.ORDERS,
        severity,
        RowCheck(predicate=lambda df: X.null_or_negative("order_amount")),
        ("order_id",),
        tuple(sample),
    )


def timestamp_parseable(
    table: str,
    column: str,
    keys: Sequence[str],
    rule_id: str,
    severity: str,
    sample: Sequence[str],
) -> Rule:
    return Rule(
        rule_id,
        f"Unparseable timestamp in {column}",
        table,
        severity,
        RowCheck(predicate=lambda df: X.lenient_instant(df, column).isNull()),
        tuple(keys),
        tuple(sample),
    )


def orders_without_events(rule_id: str, severity: str, sample: Sequence[str]) -> Rule:
    return Rule(
        rule_id,
        "Orders without any events",
        S.ORDERS,
        severity,
        OrdersWithoutEvents(),
        ("order_id",),
        tuple(sample),
    )


def events_without_orders(rule_id: str, severity: str, sample: Sequence[str]) -> Rule:
    return Rule(
        rule_id,
        "Events without matching order",
        S.ORDER_EVENTS,
        severity,
        EventsWithoutOrders(),
        ("order_id", "event_id"),
        tuple(sample),
    )


def completed_without_payment(rule_id: str, severity: str) -> Rule:
    return Rule(
        rule_id,
        "Completed orders missing payment_confirmed event",
        S.ORDERS,
        severity,
        CompletedWithoutPayment(population=f"order_status = '{S.COMPLETED}'"),
        ("order_id",),
        ("order_id",),
    )


def event_not_before_order(rule_id: str, severity: str, sample: Sequence[str]) -> Rule:
    return Rule(
        rule_id,
        "Event timestamp earlier than order_created_at",
        S.ORDER_EVENTS,
        severity,
        EventBeforeOrder(),
        ("order_id", "event_id"),
        tuple(sample),
    )
