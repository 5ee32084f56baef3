from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerlane.functions import exprs as X


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def moment(text):
    return F.lit(text).cast("timestamp_ntz")


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("2024-03-05 23:30:00", dt.datetime(2024, 3, 5, 23, 30)),
        ("2024-03-05 23:30:00.5", dt.datetime(2024, 3, 5, 23, 30, 0, 500000)),
        ("2024-03-05 23:30:00.123456+00:00", dt.datetime(2024, 3, 5, 23, 30, 0, 123456)),
        ("2024-03-05 23:30:00+02:00", dt.datetime(2024, 3, 5, 21, 30)),
        ("2024-03-05 23:30:00Z", dt.datetime(2024, 3, 5, 23, 30)),
        ("2024-02-30 00:00:00", None),
        ("2024-03-05 25:00:00", None),
        ("2024", None),
        ("2024-03-05", dt.datetime(2024, 3, 5)),
        ("2024-03-05T23:30", dt.datetime(2024, 3, 5, 23, 30)),
        ("2024-03-05T23:30:00.123456789Z", dt.datetime(2024, 3, 5, 23, 30, 0, 123456)),
        ("2024-03-05 23:30 +0130", dt.datetime(2024, 3, 5, 22, 0)),
        ("2024-03-05T23:30:00.5-01", dt.datetime(2024, 3, 6, 0, 30, 0, 500000)),
        ("2024-03-05Z", None),
        ("12:30", None),
        ("12:30", None),
        ("not-a-date", None),
        ("", None),
        (None, None),
    ],
)
@pytest.mark.parametrize("zone", ["UTC", "Europe/Helsinki", "America/New_York"])
def test_text_to_utc_wall_time_in_any_session_zone(spark, text, expected, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        column = X.utc_wall_time(X.parse_instant(F.lit(text).cast("string")))
        assert value(spark, column) == expected
        direct = X.parse_wall_time(F.lit(text).cast("string"))
        assert value(spark, direct) == expected
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_strict_conversion_fails_on_a_bad_text(spark):
    good = spark.createDataFrame([("2024-01-01 10:00:00+02:00",)], "t string")
    assert good.select(X.utc_timestamp(good, "t")).first()[0] == dt.datetime(2024, 1, 1, 8)
    bad = spark.createDataFrame([("not-a-date",)], "t string")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        bad.select(X.utc_timestamp(bad, "t")).collect()


def test_zoneless_timestamps_are_read_as_utc_in_any_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "Europe/Helsinki")
    try:
        df = spark.sql("SELECT TIMESTAMP_NTZ '2024-03-31 03:30:00' AS t")
        back = df.select(X.utc_wall_time(X.lenient_instant(df, "t")).alias("t"))
        assert back.first()["t"] == dt.datetime(2024, 3, 31, 3, 30)
        assert df.select(X.utc_timestamp(df, "t")).first()[0] == back.first()["t"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


@pytest.mark.parametrize(
    ("start", "end", "minutes"),
    [
        ("2024-01-01 00:00:59", "2024-01-01 00:01:00", 1),
        ("2024-01-01 00:00:00", "2024-01-01 00:00:59", 0),
        ("2024-01-01 00:01:00", "2024-01-01 00:00:59", -1),
        ("2024-01-01 23:59:30", "2024-01-02 00:00:10", 1),
    ],
)
def test_minute_boundaries_are_counted_not_elapsed_minutes(spark, start, end, minutes):
    assert value(spark, X.minute_boundaries(moment(start), moment(end))) == minutes


def test_guarded_ratios(spark):
    zero, two, missing = F.lit(0.0), F.lit(2.0), F.lit(None).cast("double")
    assert value(spark, X.percent_or_null(two, zero)) is None
    assert value(spark, X.percent_or_null(F.lit(1), F.lit(4))) == 25.0
    assert value(spark, X.ratio_or_zero(two, zero)) == 0.0
    assert value(spark, X.ratio_or_zero(missing, two)) == 0.0
    assert value(spark, X.ratio_or_zero(F.lit(1), F.lit(4))) == 0.25


def test_conditions_on_missing_values(spark):
    df = spark.createDataFrame(
        [("a", 1.0), ("z", -1.0), (None, 0.0), ("a", None)], "s string, x double"
    )
    row = df.agg(
        F.count_if(X.null_or_outside("s", ("a",))).alias("outside"),
        F.count_if(X.null_or_negative("x")).alias("negative"),
        F.count_if(X.any_null("s", "x")).alias("missing"),
        X.count_where(F.col("s") == "a").alias("a"),
        X.sum_where(F.col("s") == "a", F.col("x")).alias("sum_a"),
    ).first()
    assert row.asDict() == {
        "outside": 2,
        "negative": 2,
        "missing": 2,
        "a": 2,
        "sum_a": 1.0,
    }
