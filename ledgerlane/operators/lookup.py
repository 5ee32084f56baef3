"""Joins of a large, possibly skewed side to a side with at most one row per key.

A plain equi-join puts all rows of one key into one task. A run therefore counts the rows
of every key once, exactly, and hands the hot keys to its joins. Both sides are then read
once: the rows of a hot key, the missing key among them, are spread over several tasks by a
number beside the key, and the one row of a hot key on the other side is repeated for each.
What is broadcast is the list of hot keys.

A key is hot with more than ``hot_rows`` rows and more than one row in HOT_SHARE of its table,
so there are fewer than HOT_SHARE hot keys in a table of any size. Without measured keys the
join stays plain, costs nothing at planning, and Catalyst may drop it where it is not needed.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A key below this many rows fits one shuffle partition comfortably.
HOT_ROWS = 1_000_000
# A hot key holds more than this part of its table, which bounds their number.
HOT_SHARE = 100_000
# Tasks that the rows of one hot key are spread over. A hot key's row on the other side is
# repeated as often, which the limit on hot keys bounds.
HOT_PARTS = 64
HOT_PART = "hot_part"
IS_HOT = "is_hot"


def hot_values(df: DataFrame, column: str, hot_rows: int = HOT_ROWS) -> list[str | None]:
    """The hot keys of a column as text, the missing key included; fewer than HOT_SHARE.

    Two jobs: the table's row count, and exact counts per key, combined before the shuffle.
    """
    limit = max(hot_rows, df.count() // HOT_SHARE)
    counts = df.groupBy(F.col(column).cast("string").alias("key")).count()
    return [r["key"] for r in counts.filter(F.col("count") > limit).select("key").collect()]


class MeasuredTables(dict):
    """Tables together with the hot keys of their key columns, measured once per run."""

    def __init__(self, tables: Mapping[str, DataFrame], hot: Mapping[str, list[str | None]]) -> None:
        super().__init__(tables)
        self.hot = dict(hot)


def measured(
    tables: Mapping[str, DataFrame], columns: Mapping[str, Sequence[str]], hot_rows: int = HOT_ROWS
) -> MeasuredTables:
    """``tables`` with the hot values of each column over the tables it is named for."""
    hot = {}
    for column, names in columns.items():
        rows = tables[names[0]].select(column)
        for name in names[1:]:
            rows = rows.unionAll(tables[name].select(column))
        hot[column] = hot_values(rows, column, hot_rows)
    return MeasuredTables(tables, hot)


def hot_frame(spark: SparkSession, values: Sequence[str | None] | None, column: str) -> DataFrame | None:
    """Hot values as a table of one column, None where there are none."""
    if not values:
        return None
    return spark.createDataFrame([(v,) for v in values], f"`{column}` string")


def hot_keys_of(tables: Mapping[str, DataFrame], column: str, nullable: bool = False) -> DataFrame | None:
    """The measured hot keys of a column; ``nullable`` gives them as stand-in columns."""
    spark = next(iter(tables.values())).sparkSession
    frame = hot_frame(spark, getattr(tables, "hot", {}).get(column), column)
    if frame is None or not nullable:
        return frame
    return with_nullable_key(frame, column).select(*NULLABLE_KEY)


def split_hot(df: DataFrame, keys: Sequence[str], hot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of ordinary and of hot keys; a missing key equals a missing key."""
    listed = F.broadcast(hot.select(*[F.col(k).alias(f"hot_{i}") for i, k in enumerate(keys)]))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & df[k].eqNullSafe(F.col(f"hot_{i}"))
    return df.join(listed, same, "left_anti"), df.join(listed, same, "left_semi")


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    how: str,
    hot: DataFrame | None = None,
    parts: int = HOT_PARTS,
) -> DataFrame:
    """Join ``left`` to ``right``, which must have at most one row per key.

    ``how`` is inner, left, left_semi or left_anti; a NULL key matches nothing.
    ``hot`` has the columns ``keys`` and fewer than HOT_SHARE rows. Both sides are read
    once: rows of hot keys get one of ``parts`` numbers on the left, and the one row of a hot
    key on the right is repeated for each number, so that the key's rows spread over as many
    tasks. A missing key matches nothing, so its rows are spread without any partner.
    """
    if hot is None:
        return left.join(right, list(keys), how)
    on = [*keys, HOT_PART]
    # By content and place: copies of one row spread too, and a task run again gives the same numbers.
    number = F.pmod(F.xxhash64(*_comparable(left)) + F.spark_partition_id(), F.lit(parts)).cast("int")
    spread = tagged_hot(left, keys, hot).withColumn(HOT_PART, F.when(F.col(IS_HOT), number).otherwise(0))
    numbers = F.when(F.col(IS_HOT), F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))
    repeated = tagged_hot(right, keys, hot).withColumn(HOT_PART, F.explode(numbers)).drop(IS_HOT)
    return spread.drop(IS_HOT).join(repeated, on, how).drop(HOT_PART)


def tagged_hot(df: DataFrame, keys: Sequence[str], hot: DataFrame) -> DataFrame:
    """``df`` with a flag for rows of hot keys; a missing key equals a missing key."""
    listed = hot.select(*[F.col(k).alias(f"hot_{i}") for i, k in enumerate(keys)], F.lit(True).alias(IS_HOT))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & df[k].eqNullSafe(F.col(f"hot_{i}"))
    found = df.join(F.broadcast(listed), same, "left").drop(*[f"hot_{i}" for i in range(len(keys))])
    return found.withColumn(IS_HOT, F.coalesce(IS_HOT, F.lit(False)))


def _comparable(df: DataFrame) -> list[str]:
    """Columns whose values spread rows; maps cannot be hashed."""
    return [f"`{f.name}`" for f in df.schema.fields if "map<" not in f.dataType.simpleString()]


# Stand-ins for a nullable key, under which a missing key equals a missing key.
KEY_VALUE = "key_value"
KEY_MISSING = "key_missing"
NULLABLE_KEY = [KEY_VALUE, KEY_MISSING]


def with_nullable_key(df: DataFrame, column: str) -> DataFrame:
    """Add the stand-in columns of a key, compared as text.

    Added before grouping and joining alike, they let the join use plain equality and
    the partitioning the grouping has already produced.
    """
    return df.withColumns(
        {
            KEY_VALUE: F.coalesce(F.col(column).cast("string"), F.lit("")),
            KEY_MISSING: F.col(column).isNull(),
        }
    )
