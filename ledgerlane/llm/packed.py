"""Shuffles of packed arrays: one row per task and key range instead of one per entry.

Where an operator moves many small numbers, a task sorts its entries by a 64-bit key, cuts
them into as many key ranges as there are shuffle partitions and emits one row of byte
strings per range. A reducer gets all rows of its range and works on whole arrays. Keys
are hashes, so ranges are even; tasks pre-aggregate where a key may be frequent.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def ranges(spark: SparkSession) -> int:
    """As many key ranges as shuffle partitions."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def range_of(key: np.ndarray, count: int) -> np.ndarray:
    """The range of each 64-bit key; rises with the key."""
    return ((key >> np.uint64(32)) * np.uint64(count) >> np.uint64(32)).astype(np.int64)


def cut(key: np.ndarray, count: int) -> Iterator[tuple[int, np.ndarray]]:
    """(range, entry numbers) of every non-empty range."""
    where = range_of(key, count)
    order = np.argsort(where.astype(np.uint16) if count < 1 << 16 else where, kind="stable")
    bounds = np.searchsorted(where[order], np.arange(count + 1))
    for r in np.flatnonzero(np.diff(bounds)):
        yield int(r), order[bounds[r] : bounds[r + 1]]


def row_batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    """A batch of (range, bytes...) rows."""
    columns = [pa.array([r[0] for r in rows], pa.int32())]
    columns += [pa.array([r[i] for r in rows], pa.large_binary()).cast(pa.binary()) for i in range(1, len(names))]
    return pa.RecordBatch.from_arrays(columns, names=names)


def schema(names: list[str]) -> str:
    return ", ".join(["range int", *[f"{n} binary" for n in names[1:]]])


def reduce_ranges(
    rows: DataFrame, work: Callable[[dict[str, list[bytes]], int], Iterator[pa.RecordBatch]], out: str
) -> DataFrame:
    """``work(columns, range)`` once per key range, with the byte strings of all its rows."""
    count = ranges(rows.sparkSession)
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, dict[str, list[bytes]]] = {}
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for row in zip(*columns, strict=True):
                own = held.setdefault(row[0], {n: [] for n in names[1:]})
                for n, value in zip(names[1:], row[1:], strict=True):
                    own[n].append(value)
        for r in list(held):
            yield from work(held.pop(r), r)

    return rows.repartitionById(count, "range").mapInArrow(run, out)


def joined(parts: list[bytes], kind) -> np.ndarray:
    return np.frombuffer(b"".join(parts), kind)
