"""Tables stored in buckets of a key, so that joins and groupings by it need no shuffle.

A bucket is read by one task, so the rows of hot keys are kept apart, in a plain table beside
it. Both have the same columns; together they are the table.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlane.operators.lookup import IS_HOT, tagged_hot
from ledgerlane.sources.sinks import Warehouse

HOT_SUFFIX = "_hot_rows"


@dataclass(frozen=True)
class KeyedTable:
    """Rows of ordinary keys, in buckets, and of hot keys; ``hot`` is None where there are none."""

    ordinary: DataFrame
    hot: DataFrame | None = None

    def whole(self) -> DataFrame:
        return self.ordinary if self.hot is None else self.ordinary.unionByName(self.hot)

    def each(self, step: Callable[[DataFrame], DataFrame]) -> KeyedTable:
        """``step`` applied to both; right for steps that work within keys."""
        return KeyedTable(step(self.ordinary), None if self.hot is None else step(self.hot))


def write_keyed(warehouse: Warehouse, table: str, df: DataFrame, key: str, buckets: int, hot: DataFrame | None = None) -> None:
    """Replace a keyed table; ``hot`` has the hot keys in a column named like the key.

    Rows are dealt out by the key first, so that each bucket is one file.
    """
    beside = warehouse.name(table + HOT_SUFFIX)
    if hot is None:
        ordinary = df
        warehouse.spark.sql(f"DROP TABLE IF EXISTS {beside}")
    else:
        tagged = tagged_hot(df, [key], hot)
        ordinary = tagged.where(~F.col(IS_HOT)).drop(IS_HOT)
        tagged.where(IS_HOT).drop(IS_HOT).write.mode("overwrite").format("parquet").saveAsTable(beside)
    dealt = ordinary.repartition(buckets, key).write.mode("overwrite").format("parquet")
    dealt.bucketBy(buckets, key).sortBy(key).saveAsTable(warehouse.name(table))


def read_keyed(warehouse: Warehouse, table: str) -> KeyedTable:
    beside = table + HOT_SUFFIX
    return KeyedTable(warehouse.table(table), warehouse.table(beside) if warehouse.exists(beside) else None)
