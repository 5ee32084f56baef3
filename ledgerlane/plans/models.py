"""Staging views, the per-order event summary, and the two fact tables.

Each model is a function from DataFrames to a lazy DataFrame. As long as nothing is
materialised in between, Catalyst prunes columns through all of them, and drops the
join to the event summary where a query reads order columns only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlane import schemas as S
from ledgerlane.functions import exprs as X
from ledgerlane.operators.lookup import hot_keys_of, lookup_join
from ledgerlane.sources.keyed import KeyedTable
from ledgerlane.sources.readers import wall_times


def stg_orders(raw: DataFrame) -> DataFrame:
    """Typed orders; a value that cannot be cast fails the query."""
    return raw.select(
        "order_id",
        "customer_id",
        X.utc_timestamp(raw, "order_created_at").alias("order_created_at"),
        F.col("order_amount").cast("double").alias("order_amount"),
        "currency",
        "order_status",
    )


def stg_order_events(raw: DataFrame) -> DataFrame:
    """Typed events; a value that cannot be cast fails the query."""
    return raw.select(
        "event_id",
        "order_id",
        "event_type",
        X.utc_timestamp(raw, "event_timestamp").alias("event_timestamp"),
        "source_system",
    )


def int_order_event_summary(events: DataFrame) -> DataFrame:
    """First time of each lifecycle event and event counts, one row per order_id."""
    kind = F.col("event_type")

    def first_time(event_type: str) -> Column:
        return F.min(F.when(kind == event_type, F.col("event_timestamp")))

    return events.groupBy("order_id").agg(
        first_time(S.ORDER_CREATED).alias("created_event_ts"),
        first_time(S.PAYMENT_CONFIRMED).alias("payment_event_ts"),
        first_time(S.ORDER_SHIPPED).alias("shipped_event_ts"),
        first_time(S.ORDER_CANCELLED).alias("cancelled_event_ts"),
        F.count("*").alias("event_count"),
        X.count_where(kind == S.PAYMENT_CONFIRMED).alias("payment_event_count"),
        X.count_where(kind == S.ORDER_SHIPPED).alias("shipped_event_count"),
    )


def fct_orders(
    orders: DataFrame, summary: DataFrame, hot: DataFrame | None = None
) -> DataFrame:
    """Every order row with its event times, presence flags and conflict flags.

    Orders are not deduplicated. An order without events keeps NULL event columns.
    """
    status = F.col("order_status")
    paid, shipped = F.col("payment_event_ts"), F.col("shipped_event_ts")
    events = summary.select(
        "order_id",
        "created_event_ts",
        "payment_event_ts",
        "shipped_event_ts",
        "cancelled_event_ts",
        "event_count",
    )
    return lookup_join(orders, events, ["order_id"], "left", hot=hot).withColumns(
        {
            "has_payment_event": X.presence_flag(paid),
            "has_shipped_event": X.presence_flag(shipped),
            "dq_completed_missing_payment_flag": X.flag(
                (status == S.COMPLETED) & paid.isNull()
            ),
            "dq_cancelled_has_shipment_flag": X.flag(
                (status == S.CANCELLED) & shipped.isNotNull()
            ),
        }
    )


def fct_daily_revenue(orders: DataFrame) -> DataFrame:
    """Completed revenue and order counts per calendar day; undated orders share a NULL day.

    Unsorted: a written table keeps no order, queries sort what they read.
    """
    completed = F.col("order_status") == S.COMPLETED
    return orders.groupBy(F.to_date("order_created_at").alias("order_date")).agg(
        X.sum_where(completed, F.col("order_amount")).alias("revenue_completed"),
        F.count("*").alias("orders_total"),
        X.count_where(completed).alias("orders_completed"),
    )


def build_models(raw: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """All five models, lazily, from raw tables whose timestamps may still be text.

    Tables that were measured (``operators.lookup.measured``) bring their hot keys along.
    """
    orders = stg_orders(wall_times(raw[S.ORDERS], "order_created_at"))
    events = stg_order_events(wall_times(raw[S.ORDER_EVENTS], "event_timestamp"))
    summary = int_order_event_summary(events)
    facts = fct_orders(orders, summary, hot_keys_of(raw, "order_id"))
    return {
        "stg_orders": orders,
        "stg_order_events": events,
        "int_order_event_summary": summary,
        "fct_orders": facts,
        "fct_daily_revenue": fct_daily_revenue(facts),
    }


def keyed_facts(orders: KeyedTable, events: KeyedTable) -> KeyedTable:
    """``fct_orders`` over tables stored in the same number of buckets of order_id, without a shuffle.

    Hot keys have one summary row each, which is broadcast; there are fewer than HOT_SHARE.
    """
    stg = orders.each(lambda df: stg_orders(wall_times(df, "order_created_at")))
    summary = events.each(lambda df: int_order_event_summary(stg_order_events(wall_times(df, "event_timestamp"))))
    facts = fct_orders(stg.ordinary, summary.ordinary)
    if stg.hot is None:
        return KeyedTable(facts)
    few = summary.ordinary.limit(0) if summary.hot is None else summary.hot
    return KeyedTable(facts, fct_orders(stg.hot, F.broadcast(few)))


# Column that facts are partitioned by when stored per period.
PERIOD = "order_period"


def with_period(facts: DataFrame, unit: str = "day") -> DataFrame:
    """Facts with the first day of the period (day, month, year) their order falls into."""
    return facts.withColumn(PERIOD, F.to_date(F.date_trunc(unit, "order_created_at")))


def in_periods(stored: DataFrame, first: str, last: str, unit: str = "day") -> DataFrame:
    """Stored facts with order days from ``first`` to ``last``; other partitions are not read."""
    low, high = (F.to_date(F.date_trunc(unit, F.lit(d).cast("date"))) for d in (first, last))
    return stored.where(F.col(PERIOD).between(low, high)).where(F.to_date("order_created_at").between(first, last))
