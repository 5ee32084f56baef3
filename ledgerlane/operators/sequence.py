"""Events dated before an order of the same key, counted without listing the pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlane.functions import exprs as X
from ledgerlane.operators.lookup import (
    NULLABLE_KEY,
    lookup_join,
    split_hot,
    with_nullable_key,
)

POINT = [*NULLABLE_KEY, "moment"]


def events_before_orders(
    orders: DataFrame, events: DataFrame, hot: DataFrame | None = None
) -> DataFrame:
    """Events earlier than at least one order row with the same order_id.

    Keeps the event columns and adds ``later_orders``: with how many order rows the
    event conflicts. A NULL order_id matches a NULL order_id. Rows whose timestamp is
    missing or does not parse take no part. ``hot`` has the hot values of order_id.
    """
    return _conflicts(orders, events, hot, _by_calendar).select(
        *events.columns, "later_orders"
    )


def conflict_counts(
    orders: DataFrame, events: DataFrame, hot: DataFrame | None = None
) -> DataFrame:
    """Numbers, in ``later_orders``, that add up to those of ``events_before_orders``.

    Without the event rows: hot keys are counted per distinct moment.
    """
    return _conflicts(orders, events, hot, _per_moment).select("later_orders")


def _conflicts(orders, events, hot, of_hot_keys) -> DataFrame:
    created = orders.select(
        "order_id",
        X.lenient_wall_time(orders, "order_created_at").alias("moment"),
    )
    dated = events.withColumn("moment", X.lenient_wall_time(events, "event_timestamp"))
    if hot is None:
        return _within_key(created, dated)
    plain_orders, hot_orders = split_hot(created, ["order_id"], hot)
    plain_events, hot_events = split_hot(dated, ["order_id"], hot)
    return _within_key(plain_orders, plain_events).unionByName(
        of_hot_keys(hot_orders, hot_events), allowMissingColumns=True
    )


def _within_key(created: DataFrame, dated: DataFrame) -> DataFrame:
    """For keys of ordinary size: one row per key with its orders' moments, sorted.

    An event violates exactly if it precedes its key's latest order; only violators are
    searched for their place among the moments. Undated orders count for no event.
    """
    moments = order_moments(with_nullable_key(created, "order_id"))
    dated = with_nullable_key(dated.filter(F.col("moment").isNotNull()), "order_id")
    found = dated.join(moments, NULLABLE_KEY).filter(F.col("moment") < F.col("latest"))
    return found.withColumn("later_orders", later_than(F.col("moments"), F.col("moment"))).drop(
        "moments", "latest", "moment", *NULLABLE_KEY
    )


def order_moments(created: DataFrame) -> DataFrame:
    """Per key, of rows with the stand-in columns: the sorted moments of its dated orders, and the latest."""
    return (
        created.filter(F.col("moment").isNotNull())
        .groupBy(*NULLABLE_KEY)
        .agg(F.array_sort(F.collect_list("moment")).alias("moments"), F.max("moment").alias("latest"))
    )


def later_than(moments: Column, moment: Column) -> Column:
    """How many entries of a sorted array are later than a moment, by binary search.

    As many halvings as the array's length has binary digits; each keeps the range in which the
    first later entry lies.
    """
    span = F.struct(F.lit(0).alias("low"), F.size(moments).alias("high"))
    halvings = F.sequence(F.lit(1), F.length(F.bin(F.size(moments))))

    def halve(at: Column, _: Column) -> Column:
        middle = F.shiftright(at["low"] + at["high"], 1)
        done = at["low"] >= at["high"]
        # The entry is read at a place inside the array even when nothing is left to halve.
        before = F.get(moments, F.least(middle, F.size(moments) - 1)) <= moment
        low = F.when(~done & before, middle + 1).otherwise(at["low"])
        high = F.when(~done & ~before, middle).otherwise(at["high"])
        return F.struct(low.alias("low"), high.alias("high"))

    return F.aggregate(halvings, span, halve, lambda at: F.size(moments) - at["low"]).cast("bigint")


def _by_calendar(created: DataFrame, dated: DataFrame) -> DataFrame:
    """For hot keys: orders are ranked by distinct moment, events look their moment up."""
    created, dated = _with_points(created), _with_points(dated)
    ranks = orders_after(created, dated).filter(F.col("later_orders") > 0).drop("asked")
    return lookup_join(dated, ranks, POINT, "inner").drop(*POINT)


def _per_moment(created: DataFrame, dated: DataFrame) -> DataFrame:
    """For hot keys, where only the number of conflicts is wanted."""
    ranks = orders_after(_with_points(created), _with_points(dated))
    return ranks.select((F.col("asked") * F.col("later_orders")).alias("later_orders"))


def _with_points(df: DataFrame) -> DataFrame:
    return with_nullable_key(df.filter(F.col("moment").isNotNull()), "order_id")


def orders_after(orders: DataFrame, points: DataFrame) -> DataFrame:
    """For each distinct (key, moment) of ``points``: how many ``orders`` are later.

    ``asked`` tells how many rows of ``points`` share the moment.
    Counts descend the calendar: later days, later seconds of the day, later moments of
    the second. Every window runs on pre-aggregated rows, so one window group holds at
    most the days of the calendar, 86,400 seconds or 1,000,000 microseconds, however
    many rows a key has.
    """
    second, day = [*NULLABLE_KEY, "second"], [*NULLABLE_KEY, "day"]
    # All levels carry both sums, so that they read one and the same shuffle of moments.
    sums = (F.sum("n").alias("n"), F.sum("asked").alias("asked"))
    was_asked = F.col("asked") > 0
    moments = (
        orders.select(*POINT, F.lit(1).alias("n"), F.lit(0).alias("asked"))
        .unionByName(points.select(*POINT, F.lit(0).alias("n"), F.lit(1).alias("asked")))
        .groupBy(*POINT)
        .agg(*sums)
        .withColumn("second", F.date_trunc("SECOND", "moment"))
    )
    seconds = moments.groupBy(*second).agg(*sums).withColumn("day", F.to_date("second"))
    days = (
        seconds.groupBy(*day)
        .agg(*sums)
        .withColumn("in_later_days", _later(NULLABLE_KEY, "day"))
        .filter(was_asked)
        .drop("n", "asked")
    )
    seconds = (
        seconds.withColumn("in_later_seconds", _later(day, "second"))
        .filter(was_asked)
        .join(days, day)
        .select(
            *second,
            (F.col("in_later_seconds") + F.col("in_later_days")).alias("after_second"),
        )
    )
    return (
        moments.withColumn("in_second", _later(second, "moment"))
        .filter(was_asked)
        .join(seconds, second)
        .select(
            *POINT,
            "asked",
            (F.col("in_second") + F.col("after_second")).alias("later_orders"),
        )
    )


def _later(group: list[str], order: str) -> Column:
    after = (
        Window.partitionBy(*group)
        .orderBy(F.desc(order))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return F.coalesce(F.sum("n").over(after), F.lit(0))
