from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ledgerlane.operators import lookup as K


@pytest.fixture
def sides(spark):
    left = spark.createDataFrame(
        [("hot", i) for i in range(40)]
        + [(None, i) for i in range(30)]
        + [(f"k{i % 7}", i) for i in range(20)],
        "key string, row int",
    )
    right = spark.createDataFrame(
        [("hot", "H"), ("k1", "A"), ("k2", "B"), ("alone", "C"), (None, "N")],
        "key string, mark string",
    )
    return left, right


def rows(df):
    return sorted(df.select(sorted(df.columns)).collect(), key=str)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_isolating_hot_keys_does_not_change_the_result(spark, sides, how):
    left, right = sides
    plain = rows(left.join(right, "key", how))
    assert rows(K.lookup_join(left, right, ["key"], how)) == plain
    for hot in ([], ["hot"], ["hot", None, "k1", "k6"]):
        frame = K.hot_frame(spark, hot, "key")
        assert rows(K.lookup_join(left, right, ["key"], how, frame)) == plain


def test_keys_above_the_limit_are_found_missing_keys_included(sides):
    left, _ = sides
    assert set(K.hot_values(left, "key", hot_rows=25)) == {"hot", None}
    assert K.hot_values(left, "key", hot_rows=35) == ["hot"]
    assert K.hot_values(left, "key", hot_rows=100) == []
    assert K.hot_values(left.limit(0), "key", hot_rows=1) == []


def test_a_key_of_twenty_million_rows_in_a_tiny_file_is_isolated(spark, tmp_path):
    """Run-length encoding makes a skewed table small; its rows are counted, not its bytes."""
    path = str(tmp_path / "one")
    spark.range(0, 20_000_000, 1, 8).select(
        F.when(F.col("id") % 100_000 == 0, F.col("id").cast("string")).otherwise("hot").alias("key")
    ).write.parquet(path)
    left = spark.read.parquet(path)
    assert K.hot_values(left, "key") == ["hot"]
    right = spark.createDataFrame([("hot", 1), ("100000", 2)], "key string, mark int")
    joined = K.lookup_join(left, right, ["key"], "left", K.hot_frame(spark, ["hot"], "key"))
    found = joined.groupBy("mark").count().collect()
    assert {r["mark"]: r["count"] for r in found} == {1: 19_999_800, 2: 1, None: 199}


def test_measured_tables_hand_their_keys_on(spark, sides):
    left, right = sides
    tables = K.measured({"a": left, "b": right}, {"key": ("a", "b")}, hot_rows=25)
    assert set(tables.hot["key"]) == {"hot", None}
    assert rows(K.hot_keys_of(tables, "key", nullable=True)) == [(False, "hot"), (True, "")]
    assert K.hot_keys_of({"a": left}, "key") is None


def test_nullable_keys_match_each_other_but_not_the_empty_text(spark):
    left = spark.createDataFrame([(None, 1), ("", 2), ("a", 3)], "key string, row int")
    right = spark.createDataFrame([(None,), ("a",)], "key string")
    joined = K.lookup_join(
        K.with_nullable_key(left, "key"),
        K.with_nullable_key(right, "key").select(*K.NULLABLE_KEY),
        K.NULLABLE_KEY,
        "left_semi",
    )
    assert sorted(r["row"] for r in joined.collect()) == [1, 3]
