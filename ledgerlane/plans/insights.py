"""Named business questions over ``fct_orders`` and ``fct_daily_revenue``."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlane import schemas as S
from ledgerlane.functions import exprs as X

AMOUNT = "order_amount"


def _status(value: str) -> Column:
    return F.col("order_status") == value


def _paid() -> Column:
    return _status(S.COMPLETED) & (F.col("has_payment_event") == 1)


def _two(column: Column) -> Column:
    return F.round(column, 2)


def revenue_gap(fct_orders: DataFrame) -> DataFrame:
    """Completed against paid revenue; the gap in percent is NULL without revenue."""
    sums = fct_orders.agg(
        F.count("*").alias("orders_total"),
        X.count_where(_status(S.COMPLETED)).alias("orders_completed"),
        X.count_where(_paid()).alias("orders_paid"),
        X.sum_where(_status(S.COMPLETED), F.col(AMOUNT)).alias("completed"),
        X.sum_where(_paid(), F.col(AMOUNT)).alias("paid"),
    )
    completed, paid = F.col("completed"), F.col("paid")
    return sums.select(
        "orders_total",
        "orders_completed",
        "orders_paid",
        _two(completed).alias("completed_revenue"),
        _two(paid).alias("paid_revenue"),
        _two(completed - paid).alias("revenue_gap"),
        _two(X.percent_or_null(completed - paid, completed)).alias("revenue_gap_pct"),
    )


def conflict_flags(fct_orders: DataFrame) -> DataFrame:
    return fct_orders.agg(
        F.sum("dq_completed_missing_payment_flag").alias(
            "completed_missing_payment_orders"
        ),
        F.sum("dq_cancelled_has_shipment_flag").alias("cancelled_has_shipment_orders"),
    )


def status_kpis(fct_orders: DataFrame) -> DataFrame:
    return fct_orders.agg(
        F.count("*").alias("orders_total"),
        X.count_where(_status(S.COMPLETED)).alias("orders_completed"),
        X.count_where(_status(S.CANCELLED)).alias("orders_cancelled"),
        X.count_where(_status(S.REFUNDED)).alias("orders_refunded"),
        _two(X.sum_where(_status(S.COMPLETED), F.col(AMOUNT))).alias(
            "revenue_completed"
        ),
    )


def daily_revenue(fct_daily_revenue: DataFrame) -> DataFrame:
    return fct_daily_revenue.select(
        "order_date",
        _two(F.col("revenue_completed")).alias("revenue_completed"),
        "orders_total",
        "orders_completed",
    ).orderBy(F.asc_nulls_last("order_date"))


def average_order_value(fct_orders: DataFrame) -> DataFrame:
    return fct_orders.filter(_status(S.COMPLETED)).agg(
        _two(F.avg(AMOUNT)).alias("avg_order_value_completed")
    )


def top_customers(fct_orders: DataFrame, n: int = 10) -> DataFrame:
    """Customers by completed revenue; equal revenues are ordered by customer."""
    return (
        fct_orders.filter(_status(S.COMPLETED))
        .groupBy(F.coalesce("customer_id", F.lit("UNKNOWN")).alias("customer_id"))
        .agg(_two(F.sum(AMOUNT)).alias("revenue_completed"))
        .orderBy(F.desc_nulls_last("revenue_completed"), "customer_id")
        .limit(n)
    )


def payment_to_shipment(fct_orders: DataFrame) -> DataFrame:
    lag = X.minute_boundaries(F.col("payment_event_ts"), F.col("shipped_event_ts"))
    return (
        fct_orders.filter(_paid() & (F.col("has_shipped_event") == 1))
        .select(lag.alias("minutes"))
        .filter(F.col("minutes") >= 0)
        .agg(
            _two(F.avg("minutes")).alias("avg_minutes_payment_to_ship"),
            F.min("minutes").alias("min_minutes_payment_to_ship"),
            F.max("minutes").alias("max_minutes_payment_to_ship"),
        )
    )


def _coverage(fct_orders: DataFrame, names: dict[str, str]) -> DataFrame:
    return fct_orders.agg(
        *[
            _two(
                X.percent_or_null(
                    X.count_where(F.col(column).isNotNull()), F.count("*")
                )
            ).alias(name)
            for column, name in names.items()
        ]
    )


def event_coverage_pct(fct_orders: DataFrame) -> DataFrame:
    return _coverage(
        fct_orders,
        {
            "created_event_ts": "pct_with_created_event",
            "payment_event_ts": "pct_with_payment_event",
            "shipped_event_ts": "pct_with_shipped_event",
            "cancelled_event_ts": "pct_with_cancelled_event",
        },
    )


def event_coverage(fct_orders: DataFrame) -> DataFrame:
    """The same shares named by event type."""
    return _coverage(
        fct_orders,
        {
            "created_event_ts": S.ORDER_CREATED,
            "payment_event_ts": S.PAYMENT_CONFIRMED,
            "shipped_event_ts": S.ORDER_SHIPPED,
            "cancelled_event_ts": S.ORDER_CANCELLED,
        },
    )


def orders_without_events(fct_orders: DataFrame) -> DataFrame:
    """Orders lacking all four lifecycle times (an unknown event type does not count)."""
    return fct_orders.filter(
        F.col("created_event_ts").isNull()
        & F.col("payment_event_ts").isNull()
        & F.col("shipped_event_ts").isNull()
        & F.col("cancelled_event_ts").isNull()
    ).agg(F.count("*").alias("orders_without_events"))


def _sum_or_zero(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col(AMOUNT))), F.lit(0.0))


def _with_gap(df: DataFrame, gap: str, pct: str) -> DataFrame:
    """Unrounded gap; the percentage is 0.0 without revenue."""
    completed = F.col("completed_revenue")
    return df.withColumn(gap, completed - F.col("paid_revenue")).withColumn(
        pct, X.ratio_or_zero(F.col(gap), completed) * 100.0
    )


def revenue_metrics(fct_orders: DataFrame) -> DataFrame:
    """The nine-field metrics record in one pass; empty input gives zeros."""

    def flags(column: str) -> Column:
        return F.coalesce(F.sum(column), F.lit(0))

    sums = fct_orders.agg(
        F.count_if(_status(S.COMPLETED)).alias("completed_orders"),
        _sum_or_zero(_status(S.COMPLETED)).alias("completed_revenue"),
        F.count_if(_paid()).alias("paid_orders"),
        _sum_or_zero(_paid()).alias("paid_revenue"),
        flags("dq_completed_missing_payment_flag").alias("missing_payment_orders"),
        flags("dq_cancelled_has_shipment_flag").alias("cancelled_with_shipment_orders"),
        F.count_if(_status(S.COMPLETED) & F.col("customer_id").isNull()).alias(
            "completed_missing_customer_orders"
        ),
    )
    return _with_gap(sums, "revenue_gap", "revenue_gap_pct").select(
        "completed_orders",
        "completed_revenue",
        "paid_orders",
        "paid_revenue",
        "revenue_gap",
        "revenue_gap_pct",
        "missing_payment_orders",
        "cancelled_with_shipment_orders",
        "completed_missing_customer_orders",
    )


def revenue_definitions(fct_orders: DataFrame) -> DataFrame:
    sums = fct_orders.agg(
        _sum_or_zero(_status(S.COMPLETED)).alias("completed_revenue"),
        _sum_or_zero(_paid()).alias("paid_revenue"),
    )
    return _with_gap(sums, "gap", "gap_pct")


def daily_revenue_ma7(fct_daily_revenue: DataFrame) -> DataFrame:
    """Daily revenue with the mean of the last seven rows, missing days skipped as rows.

    The unpartitioned window sees one row per calendar day: a few thousand in practice
    and under four million over every date Spark can hold, whatever the order volume.
    """
    last_seven = Window.orderBy(F.asc_nulls_last("order_date")).rowsBetween(-6, 0)
    return fct_daily_revenue.select(
        "order_date",
        "revenue_completed",
        "orders_total",
        "orders_completed",
        F.avg("revenue_completed").over(last_seven).alias("revenue_ma7"),
    )


def daily_revenue_bounds(fct_daily_revenue: DataFrame) -> DataFrame:
    return fct_daily_revenue.agg(
        F.min("order_date").alias("start_date"),
        F.max("order_date").alias("end_date"),
        F.max("revenue_completed").alias("max_revenue_completed"),
    )


def completed_missing_events(fct_orders: DataFrame) -> DataFrame:
    """How many completed orders lack a payment or shipment time; zeros stay NULL-guarded."""
    counts = fct_orders.filter(_status(S.COMPLETED)).agg(
        F.count("*").alias("completed_orders"),
        X.count_where(F.col("payment_event_ts").isNull()).alias("missing_payment"),
        X.count_where(F.col("shipped_event_ts").isNull()).alias("missing_shipped"),
    )
    whole = F.col("completed_orders")
    return counts.withColumns(
        {
            f"{name}_pct": _two(X.percent_or_null(F.col(name), whole))
            for name in ("missing_payment", "missing_shipped")
        }
    )


@dataclass(frozen=True)
class Insight:
    """A named question: the table it reads and the query that answers it."""

    name: str
    title: str
    table: str
    query: Callable[[DataFrame], DataFrame]


INSIGHTS: tuple[Insight, ...] = (
    Insight(
        "insight_01_revenue_gap", "Completed and paid revenue", "fct_orders", revenue_gap
    ),
    Insight(
        "insight_02_conflict_flags", "Conflicting orders", "fct_orders", conflict_flags
    ),
    Insight("insight_03_status_kpis", "Orders by status", "fct_orders", status_kpis),
    Insight(
        "insight_04_daily_revenue",
        "Revenue by day",
        "fct_daily_revenue",
        daily_revenue,
    ),
    Insight(
        "insight_05_average_order_value",
        "Average completed order",
        "fct_orders",
        average_order_value,
    ),
    Insight(
        "insight_06_top_customers", "Leading customers", "fct_orders", top_customers
    ),
    Insight(
        "insight_07_payment_to_shipment",
        "Minutes from payment to shipment",
        "fct_orders",
        payment_to_shipment,
    ),
    Insight(
        "insight_08_event_coverage_pct",
        "Orders with each event",
        "fct_orders",
        event_coverage_pct,
    ),
    Insight(
        "insight_09_orders_without_events",
        "Orders without events",
        "fct_orders",
        orders_without_events,
    ),
)

VALIDATIONS: tuple[Insight, ...] = (
    Insight("revenue_metrics", "Revenue metrics", "fct_orders", revenue_metrics),
    Insight(
        "daily_revenue_ma7",
        "Daily revenue, seven-row mean",
        "fct_daily_revenue",
        daily_revenue_ma7,
    ),
    Insight(
        "daily_revenue_bounds",
        "First day, last day, peak",
        "fct_daily_revenue",
        daily_revenue_bounds,
    ),
    Insight("event_coverage", "Event coverage", "fct_orders", event_coverage),
    Insight(
        "completed_missing_events",
        "Completed orders lacking events",
        "fct_orders",
        completed_missing_events,
    ),
    Insight(
        "revenue_definitions", "Revenue definitions", "fct_orders", revenue_definitions
    ),
)
