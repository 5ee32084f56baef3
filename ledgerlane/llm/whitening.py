"""Embeddings projected on their leading principal components and scaled to unit variance.

Components become whole numbers x = floor(64 c) + 1,000,000. The fit list is each distinct x
vector once, so that copies, however many, weigh as one.

1. Distinct vectors are grouped packed, copies combined before the shuffle, and written once.
2. Every task sums its vectors exactly; Spark adds these sums up per dimension.
3. Every task centres its vectors and adds up products of the centred ones. The mean is taken off
   in two exact steps, a whole number first and the rest as a double, so that large
   offsets cost no digits. Tasks send one row per matrix row, and these are added up by matrix row.
4. One task per vector length, holding a matrix as wide as the vectors, finds the leading
   eigenvectors (``eigen``: Householder, Sturm counts, inverse iteration).
5. The components, at most ``components`` vectors, go to all tasks, which project the fit list to
   measure how far the result's covariance is from the identity, and then all rows.

Results for odd rows: vectors that are null or hold null or non-finite entries are dropped.
Vectors of each length are a space of their own, with a fit list of their own. Repeated rows each
get a result; a null id is passed on. A vector without entries has no components. Where a
component's variance is at most RANK of the largest (copies of one vector, fewer vectors than
components), it is not told apart from rounding: ``whitened`` is null, ``explained`` 0, and the
identity is measured without it. ``deviation`` is null where it exceeds a long. An empty
table gives an empty result. Columns other than id and vector are not looked at. An entry of 2 ** 34
or more in size ends the run with an OverflowError.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlane.llm import eigen, integers
from ledgerlane.llm.jobs import ready, stored

#: Added to every whole number.
OFFSET = 1_000_000
#: A component's variance counts as none at this part of the largest.
RANK = 1e-10
#: Bytes of sums, or of components, of the vector lengths handled at once; a length alone may take more.
GROUP_BYTES = 64 << 20
#: Bytes of matrices a task holds before it sends them on.
HELD_BYTES = 64 << 20


@dataclass(frozen=True)
class Space:
    """Fit list of one vector length: n vectors with exact sums per dimension."""

    n: int
    sums: tuple[int, ...]

    def centre(self) -> tuple[np.ndarray, np.ndarray]:
        """The mean as whole numbers and a rest below one."""
        base = [s // self.n for s in self.sums]
        rest = [(s - self.n * b) / self.n for s, b in zip(self.sums, base, strict=True)]
        return np.array(base, np.int64), np.array(rest)

    def centred(self, x: np.ndarray) -> np.ndarray:
        base, rest = self.centre()
        return (x - base) - rest

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S) ** 2, exactly; None beyond a long."""
        base, _ = self.centre()
        z = x - base
        rest = [s - self.n * int(b) for s, b in zip(self.sums, base, strict=True)]
        largest = self.n * (int(np.abs(z).max(initial=0)) + 1)
        if x.shape[1] * largest * largest < 2**63:
            return ((self.n * z - np.array(rest, np.int64)) ** 2).sum(1).tolist()
        exact = [sum((self.n * a - r) ** 2 for a, r in zip(v, rest, strict=True)) for v in z.tolist()]
        return [v if v < 2**63 else None for v in exact]


@dataclass(frozen=True)
class Components:
    """What projects the vectors of one space: unit vectors over square roots of variances."""

    space: Space
    weights: np.ndarray
    explained: np.ndarray
    counted: np.ndarray
    error: float = 0.0

    def project(self, x: np.ndarray) -> np.ndarray:
        return self.space.centred(x) @ self.weights.T


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int64).reshape(-1, dim)


def _spaces(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The rows of a batch by vector length."""
    dims = batch.column("dim").to_numpy()
    for dim in np.unique(dims):
        yield int(dim), batch.filter(pa.array(dims == dim))


def packed(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """(key, dim, x) of the rows whose vectors take part; x holds the whole numbers as bytes."""
    vector = F.col(f"`{column}`")
    rows = vectors.where(integers.usable(vector) & (F.size(vector) > 0))
    rows = rows.select(F.col(f"`{key}`").alias("key"), vector.cast("array<double>").alias("vector"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in integers.by_length(batch, "vector"):
                x = integers.steps(part.column("vector"), OFFSET)
                dim = pa.array(np.full(len(x), x.shape[1], np.int32))
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), dim, pa.array([v.tobytes() for v in x], pa.binary())], names=["key", "dim", "x"]
                )

    return rows.mapInArrow(pack, f"key {rows.schema['key'].dataType.simpleString()}, dim int, x binary")


def _sums(fit: DataFrame) -> DataFrame:
    """(dim, n, sums) of the fit lists."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[int, list[int]]] = {}
        for batch in batches:
            for dim, part in _spaces(batch):
                x = _vectors(part.column("x"), dim)
                n, sums = held.get(dim, (0, [0] * dim))
                held[dim] = n + len(x), [a + b for a, b in zip(sums, x.sum(0).tolist(), strict=True)]
            if sum(map(int, held)) * 40 > HELD_BYTES:
                yield from (_sum_rows(*item) for item in held.items())
                held = {}
        yield from (_sum_rows(*item) for item in held.items())

    parts = fit.mapInArrow(add, "dim int, at int, n bigint, s bigint")
    whole = parts.groupBy("dim", "at").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    # One entry per dimension of the vectors.
    listed = F.array_sort(F.collect_list(F.struct("at", "s")))
    return whole.groupBy("dim").agg(F.max("n").alias("n"), listed.alias("sums"))


def _sum_rows(dim: int, found: tuple[int, list[int]]) -> pa.RecordBatch:
    n, sums = found
    columns = [np.full(dim, dim, np.int32), np.arange(dim, dtype=np.int32), np.full(dim, n), np.array(sums, np.int64)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["dim", "at", "n", "s"])


def _products(fit: DataFrame, spaces: dict[int, Space]) -> DataFrame:
    """(dim, at, row): the rows of each centred product matrix, added up."""
    handed = fit.sparkSession.sparkContext.broadcast(spaces)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, part in _spaces(batch):
                y = handed.value[dim].centred(_vectors(part.column("x"), dim))
                held[dim] = held[dim] + y.T @ y if dim in held else y.T @ y
            if sum(m.nbytes for m in held.values()) > HELD_BYTES:
                yield from (_matrix_rows(*item) for item in held.items())
                held = {}
        yield from (_matrix_rows(*item) for item in held.items())

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for row in batch.to_pylist():
                place, values = (row["dim"], row["at"]), np.frombuffer(row["row"])
                held[place] = held[place] + values if place in held else values
        for (dim, at), values in held.items():
            yield pa.RecordBatch.from_pylist([{"dim": dim, "at": at, "row": values.tobytes()}], schema=_ROW)

    rows = fit.mapInArrow(multiply, "dim int, at int, row binary")
    return rows.repartition("dim", "at").mapInArrow(add, "dim int, at int, row binary")


_ROW = pa.schema([("dim", pa.int32()), ("at", pa.int32()), ("row", pa.binary())])


def _matrix_rows(dim: int, matrix: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{"dim": dim, "at": i, "row": r.tobytes()} for i, r in enumerate(matrix)], schema=_ROW)


_SOLVED = "dim int, total double, `values` binary, vectors binary"


def _solved(products: DataFrame, components: int) -> DataFrame:
    """(dim, total, values, vectors): trace, leading eigenvalues and vectors of each product matrix."""

    def solve(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("at").to_pylist(), table.column("row").to_pylist(), strict=True))
        matrix = np.frombuffer(b"".join(r for _, r in rows)).reshape(len(rows), -1)
        # Both halves were added up alike; one of them decides.
        matrix = np.tril(matrix) + np.tril(matrix, -1).T
        values, vectors = eigen.leading(matrix, components)
        out = {"dim": len(rows), "total": float(np.trace(matrix)), "values": values.tobytes(), "vectors": vectors.tobytes()}
        kinds = [("dim", pa.int32()), ("total", pa.float64()), ("values", pa.binary()), ("vectors", pa.binary())]
        return pa.Table.from_pylist([out], schema=pa.schema(kinds))

    return products.groupBy("dim").applyInArrow(solve, _SOLVED)


def _components(row, space: Space) -> Components:
    values = np.frombuffer(row["values"])
    vectors = np.frombuffer(row["vectors"]).reshape(len(values), -1)
    counted = values > RANK * max(values[0], 0.0)
    weights = np.zeros_like(vectors)
    weights[counted] = vectors[counted] / np.sqrt(values[counted] / space.n)[:, None]
    explained = np.where(counted, values / (row["total"] or 1.0), 0.0)
    return Components(space, weights, explained, counted)


def _errors(fit: DataFrame, found: dict[int, Components]) -> dict[int, float]:
    """The largest entry of the projected fit list's covariance less the identity, per length."""
    handed = fit.sparkSession.sparkContext.broadcast(found)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, part in _spaces(batch):
                y = handed.value[dim].project(_vectors(part.column("x"), dim))
                y = np.column_stack([y, np.ones(len(y))])
                held[dim] = held[dim] + y.T @ y if dim in held else y.T @ y
        for dim, sums in held.items():
            columns = [np.full(sums.size, dim, np.int32), np.arange(sums.size, dtype=np.int32), sums.ravel()]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["dim", "at", "s"])

    parts = fit.mapInArrow(add, "dim int, at int, s double").groupBy("dim", "at").agg(F.sum("s").alias("s"))
    sums: dict[int, dict[int, float]] = {}
    for row in parts.collect():
        sums.setdefault(row["dim"], {})[row["at"]] = row["s"]
    out = {}
    for dim, own in sums.items():
        side = len(found[dim].counted) + 1
        whole = np.array([own[i] for i in range(side * side)]).reshape(side, side) / found[dim].space.n
        mean = whole[-1, :-1]
        away = whole[:-1, :-1] - np.outer(mean, mean) - np.eye(side - 1)
        keep = found[dim].counted
        out[dim] = float(np.abs(away[keep][:, keep]).max(initial=0.0))
    return out


def _groups(sums: DataFrame, most: int) -> Iterator[dict[int, Space]]:
    """The vector lengths with their sums, as many at once as ``most`` bytes allow."""
    held: dict[int, Space] = {}
    for row in sums.orderBy("dim").toLocalIterator():
        if held and 200 * (sum(held) + row["dim"]) > most:
            yield held
            held = {}
        held[row["dim"]] = Space(row["n"], tuple(int(s["s"]) for s in row["sums"]))
    if held:
        yield held


def whiten(
    vectors: DataFrame, components: int = 16, key: str = "vec_id", column: str = "embedding", group_bytes: int = GROUP_BYTES
) -> DataFrame:
    """(key, n, deviation, whitened, explained, identity_error) per row that takes part.

    ``whitened`` and ``explained`` are arrays with one entry per component.
    """
    spark = ready(vectors.sparkSession)
    rows = packed(vectors, key, column)
    fit = stored(rows.select("dim", "x").distinct(), "whitening-fit")
    sums = stored(_sums(fit), "whitening-sums")
    kind = f"`{key}` {rows.schema['key'].dataType.simpleString()}"
    kind += ", n bigint, deviation bigint, whitened array<double>, explained array<double>, identity_error double"
    out = None
    for spaces in _groups(sums, group_bytes):
        chosen = F.col("dim").between(min(spaces), max(spaces))
        own = fit.where(chosen)
        found = {r["dim"]: _components(r, spaces[r["dim"]]) for r in _solved(_products(own, spaces), components).collect()}
        errors = _errors(own, found)
        final = {d: Components(c.space, c.weights, c.explained, c.counted, errors[d]) for d, c in found.items()}
        part = rows.where(chosen).mapInArrow(_projection(spark.sparkContext.broadcast(final), key), kind)
        out = part if out is None else out.union(part)
    return spark.createDataFrame([], kind) if out is None else out


def _projection(handed, key: str):
    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, part in _spaces(batch):
                own = handed.value[dim]
                x = _vectors(part.column("x"), dim)
                y, size = own.project(x), len(own.counted)
                ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * size)
                lost = np.tile(~own.counted, len(x))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("key"),
                        pa.array(np.full(len(x), own.space.n)),
                        pa.array(own.space.deviations(x), pa.int64()),
                        pa.ListArray.from_arrays(ends, pa.array(y.ravel(), mask=lost)),
                        pa.ListArray.from_arrays(ends, pa.array(np.tile(own.explained, len(x)))),
                        pa.array(np.full(len(x), own.error)),
                    ],
                    names=[key, "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return project


def digest(found: DataFrame, key: str = "vec_id") -> DataFrame:
    """One row per vector and component, components numbered from 1."""
    each = F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "c")
    rows = found.select(f"`{key}`", "n", "deviation", "identity_error", each)
    return rows.select(
        f"`{key}`",
        (F.col("at") + 1).alias("component"),
        "n",
        "deviation",
        F.col("c.whitened").alias("whitened"),
        F.col("c.explained").alias("explained"),
        "identity_error",
    )
