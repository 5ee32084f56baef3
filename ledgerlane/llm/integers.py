"""Embedding columns as whole numbers: which vectors take part, and floor(64 c) of their components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Steps per unit of a component.
STEPS = 64
#: Whole numbers beyond this size are refused: their sums could not be held exactly.
LARGEST = 2**40


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    finite = F.forall(vector, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite, F.lit(False))


def steps(vectors: pa.Array, plus: int = 0) -> np.ndarray:
    """floor(64 c) + ``plus`` of the components of vectors of one length, one row per vector."""
    if not len(vectors):
        return np.zeros((0, 0), np.int64)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    whole = np.floor(STEPS * flat)
    if len(whole) and np.abs(whole).max() >= LARGEST:
        raise OverflowError(f"a component is not below {LARGEST // STEPS} in size")
    return (whole.astype(np.int64) + plus).reshape(len(vectors), -1)


def by_length(batch: pa.RecordBatch, column: str) -> list[pa.RecordBatch]:
    """The rows of a batch, divided by the length of their vectors."""
    sizes = np.diff(batch.column(column).offsets.to_numpy())
    found = np.unique(sizes)
    if len(found) < 2:
        return [batch] if batch.num_rows else []
    return [batch.filter(pa.array(sizes == n)) for n in found]


def multiplied(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of a with the rows of b, exactly, as longs."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    largest = a.shape[1] * int(np.abs(a).max()) * int(np.abs(b).max())
    if largest < 2**53:
        # Every sum is a whole number that a double holds.
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if largest < 2**63:
        return a.astype(np.int64) @ b.astype(np.int64).T
    raise OverflowError("an inner product may not fit into a long")
