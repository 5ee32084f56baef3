"""The first rows, and the first distinct keys, of each rule in a fixed order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlane import schemas as S

# Groups of tasks whose first rows are chosen before those of all tasks.
TASK_GROUPS = 256
# Buckets of keys, each represented by its least.
KEY_BUCKETS = 64


def in_order(columns: Sequence[str]) -> list[Column]:
    return [F.asc_nulls_last(c) for c in columns]


def first_rows(df: DataFrame, group: str, order: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` rows of each group, in two levels.

    Every task keeps n rows a group. Tasks are dealt into TASK_GROUPS, each of which keeps n, and
    the groups' rows meet last, so that no task takes n rows from every other.
    """
    tasks = df.withColumn("task_group", F.pmod(F.spark_partition_id(), F.lit(TASK_GROUPS)))
    few = _first(tasks, [group, "task_group"], order, n)
    return _first(few.drop("task_group"), [group], order, n)


def _first(df: DataFrame, groups: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    window = Window.partitionBy(*groups).orderBy(*in_order(order))
    return df.withColumn("position", F.row_number().over(window)).filter(F.col("position") <= n).drop("position")


def key_cells(columns: Sequence[str]) -> str:
    """SQL text: key columns as one comparable value in which missing cells come last."""
    cells = ", ".join(
        f"named_struct('missing', `{c}` IS NULL, 'cell', CAST(`{c}` AS STRING))"
        for c in columns
    )
    return f"array({cells})"


def first_keys(df: DataFrame, group: str, cells: str, n: int = 5) -> DataFrame:
    """One text per group: its first ``n`` distinct keys, cells by ``,`` and keys by ``; ``.

    Keys are dealt into KEY_BUCKETS by their hash, and each task sends one least key per group and
    bucket. The n-th of these, which are all different, bounds the n-th of all keys from above, so
    that only the few keys up to it are told apart in a second reading.
    """
    dealt = df.withColumn("bucket", F.pmod(F.xxhash64(cells), F.lit(KEY_BUCKETS)))
    least = dealt.groupBy(group, "bucket").agg(F.min(cells).alias("least"))
    ends = least.groupBy(group).agg(F.get(F.array_sort(F.collect_list("least")), F.lit(n - 1)).alias("end"))
    upto = F.col("end").isNull() | (F.col(cells) <= F.col("end"))
    near = df.join(F.broadcast(ends), group).filter(upto)  # one row per group
    keys = F.slice(F.array_sort(F.collect_list(cells)), 1, n)
    text = F.transform(
        keys,
        lambda key: F.array_join(
            F.transform(
                key, lambda c: F.coalesce(c["cell"], F.lit(S.MISSING_KEY_TEXT))
            ),
            ",",
        ),
    )
    found = near.groupBy(group, cells).agg(F.count("*").alias("rows"))
    return found.groupBy(group).agg(F.array_join(text, "; ").alias("sample_keys"))


def sample_keys(df: DataFrame, columns: Sequence[str], n: int = 5) -> DataFrame:
    """The sample-key text of a whole frame, one row; an empty text for an empty frame."""
    tagged = df.selectExpr("0 AS whole", f"{key_cells(columns)} AS cells")
    return first_keys(tagged, "whole", "cells", n).agg(
        F.coalesce(F.max("sample_keys"), F.lit("")).alias("sample_keys")
    )


def preview(df: DataFrame, n: int = 10) -> tuple[DataFrame, str]:
    """The first ``n`` rows, and whether that was ``all``, ``truncated``, ``no rows`` or ``no columns``.

    Runs the query once and keeps the ``n`` rows it shows.
    """
    if not df.columns:
        return df, "no columns"
    seen = df.take(n + 1)
    state = "no rows" if not seen else "truncated" if len(seen) > n else "all"
    return df.sparkSession.createDataFrame(seen[:n], df.schema), state
