"""Exact top-k by integer inner product: blocks in the order of their bounds, until none can help.

Components become floor(64 c). A component is two terms, its positive and its negative part, so
that a query's score of a block is at most the sum over the terms of the query's weight times the
block's largest entry of that term.

1. Documents are put in an order in which neighbours resemble each other: cells around PIVOTS
   sampled vectors, the cells themselves in the order of repeated halving. Ranges of SHARD
   documents in this order are shards, written once with their forward index (the vectors, as
   whole numbers) and the term maxima of their blocks of BLOCK documents.
2. Each query is first answered in the shard that holds it. Its k-th result there is a bound
   that every result must reach.
3. Queries go out in blocks of at most QUERY_BYTES, and each block meets all shards in one pass
   without a shuffle. A task orders the blocks of a shard by their bounds per query and
   scores block at a time through the forward index, until the next bound falls below the
   query's k-th result so far. Of ties only those with smaller ids go on: a block whose bound
   equals the k-th score is left out if all its ids are larger.
4. A task sends at most k results per query; a window keeps the first k of them all.

Nothing is approximate: the sample decides the order only, and so how much is pruned. In directions
spread evenly over many dimensions bounds prune little, and the work is that of comparing each query
with all rows, as the query set grows with the table.

Results for odd rows: vectors that are null or hold null or non-finite components take no part, nor
do rows without an id. Vectors meet vectors of their own length only. A query's own id is no
candidate for it; other repeated rows each count. Repeated queries with the same id and vector
ask once. Ties go to smaller ids; scores that would not fit into a long end the query with
an OverflowError; an empty table gives an empty result. Columns other than id and vector are not
looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlane.llm import integers
from ledgerlane.llm.jobs import ready, stored
from ledgerlane.llm.packed import ranges

#: Sampled vectors that cells lie around, about; at most four times as many are taken.
PIVOTS = 1024
#: Documents of a shard and of a block.
SHARD, BLOCK = 4096, 64
#: Bytes of query vectors sent to all tasks at once.
QUERY_BYTES = 16 << 20
#: Queries whose bounds a task holds at once.
AT_ONCE = 1024

_LEAST = np.iinfo(np.int64).min
_LAST = np.iinfo(np.int64).max

_SHARDS = "shard bigint, dim int, ids binary, asks binary, x binary, high binary, low binary, first binary"


def halved(x: np.ndarray) -> np.ndarray:
    """An order of the rows in which halves, quarters and so on lie together: split along the widest direction."""
    order, todo = [], [np.arange(len(x))]
    while todo:
        rows = todo.pop()
        if len(rows) <= 2:
            order.extend(rows)
            continue
        y = x[rows] - x[rows].mean(0)
        axis = y[np.argmax((y * y).sum(1))]
        for _ in range(8):
            axis = y.T @ (y @ axis)
            axis = axis / (np.sqrt(axis @ axis) or 1.0)
        by = rows[np.argsort(y @ axis, kind="stable")]
        todo += [by[len(by) // 2 :], by[: len(by) // 2]]
    return np.array(order, np.int64)


class Shard:
    """Some documents of neighbouring places: ids, forward index and the term bounds of their blocks."""

    def __init__(self, ids, asks, x, high=None, low=None, first=None, block: int = BLOCK) -> None:
        self.ids, self.asks, self.x, self.block = ids, asks, x, block
        at = np.arange(0, len(ids), block)
        self.high = np.maximum.reduceat(x, at, axis=0) if high is None else high
        self.low = np.minimum.reduceat(x, at, axis=0) if low is None else low
        self.first = np.minimum.reduceat(ids, at) if first is None else first

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """The largest score any document of each block can have, per query."""
        return integers.multiplied(np.maximum(q, 0), self.high) + integers.multiplied(np.minimum(q, 0), self.low)

    def whole_bounds(self, q: np.ndarray) -> np.ndarray:
        """The same for all documents together."""
        high, low = self.high.max(0)[None], self.low.min(0)[None]
        return (integers.multiplied(np.maximum(q, 0), high) + integers.multiplied(np.minimum(q, 0), low))[:, 0]

    def rows(self, block: int) -> slice:
        return slice(block * self.block, (block + 1) * self.block)


class Best:
    """The k best (score, id) of some queries so far, and what a result must reach at least."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int, score=None, last=None) -> None:
        self.own, self.q, self.k = ids, q, k
        self.scores = np.full((len(ids), k), _LEAST)
        self.ids = np.full((len(ids), k), _LAST)
        #: A document counts with a score above ``least``, or with that score and an id up to ``upto``.
        self.least = np.full(len(ids), _LEAST) if score is None else score.copy()
        self.upto = np.full(len(ids), _LAST) if last is None else last.copy()

    def may_hold(self, rows: np.ndarray, bound: np.ndarray, first_id: np.ndarray) -> np.ndarray:
        return (bound > self.least[rows]) | ((bound == self.least[rows]) & (first_id <= self.upto[rows]))

    def take(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Scores of the documents ``ids`` for the queries ``rows``."""
        good = self.may_hold(rows[:, None], scores, ids[None, :]) & (ids[None, :] != self.own[rows][:, None])
        some = np.flatnonzero(good.any(1))
        if not len(some):
            return
        rows, good = rows[some], good[some]
        new = np.where(good, scores[some], _LEAST)
        new_ids = np.where(good, np.broadcast_to(ids, good.shape), _LAST)
        all_scores = np.concatenate([self.scores[rows], new], axis=1)
        all_ids = np.concatenate([self.ids[rows], new_ids], axis=1)
        # ~s falls as s rises and, unlike -s, has no value without a counterpart.
        by = np.lexsort((all_ids, ~all_scores), axis=1)[:, : self.k]
        self.scores[rows] = np.take_along_axis(all_scores, by, 1)
        self.ids[rows] = np.take_along_axis(all_ids, by, 1)
        score, last = self.scores[rows, -1], self.ids[rows, -1]
        full = last != _LAST
        better = full & ((score > self.least[rows]) | ((score == self.least[rows]) & (last < self.upto[rows])))
        self.least[rows[better]], self.upto[rows[better]] = score[better], last[better]


def scan(shard: Shard, best: Best, rows: np.ndarray) -> int:
    """Bring the results of the queries ``rows`` up to date with a shard; the number of blocks scored."""
    scored = 0
    for at in range(0, len(rows), AT_ONCE):
        part = rows[at : at + AT_ONCE]
        part = part[best.may_hold(part, shard.whole_bounds(best.q[part]), np.full(len(part), shard.first.min()))]
        if not len(part):
            continue
        bounds = shard.bounds(best.q[part])
        order = np.argsort(~bounds, axis=1, kind="stable")
        live = np.arange(len(part))
        for turn in range(bounds.shape[1]):
            block = order[live, turn]
            # Bounds only fall from here on: a query whose bound is below its k-th score is done.
            live = live[bounds[live, block] >= best.least[part[live]]]
            block = order[live, turn]
            if not len(live):
                break
            good = best.may_hold(part[live], bounds[live, block], shard.first[block])
            for b in np.unique(block[good]):
                mine = part[live[good & (block == b)]]
                own = shard.rows(b)
                best.take(mine, integers.multiplied(best.q[mine], shard.x[own]), shard.ids[own])
                scored += len(mine)
    return scored


def _shard_of(row: dict, block: int) -> Shard:
    ids = np.frombuffer(row["ids"], np.int64)
    asks = np.frombuffer(row["asks"], np.bool_)
    x, high, low = (np.frombuffer(row[c], np.int64).reshape(-1, max(1, row["dim"])) for c in ("x", "high", "low"))
    return Shard(ids, asks, x, high, low, np.frombuffer(row["first"], np.int64), block)


def _padded(x: np.ndarray) -> np.ndarray:
    """Vectors without components get one that is zero."""
    return x if x.shape[1] else np.zeros((len(x), 1), np.int64)


def shards(rows: DataFrame, pivots: int = PIVOTS, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """The forward index of (vec_id, vector, asks): documents in the order of cells, packed and written once."""
    spark = rows.sparkSession
    total = rows.count()
    every = max(1, total // pivots)
    sampled = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(every)) == 0).limit(4 * pivots)
    tops: dict[int, np.ndarray] = {}
    taken = sampled.select("vector").distinct().toArrow()
    for batch in taken.to_batches():
        for part in integers.by_length(batch, "vector"):
            x = integers.steps(part.column("vector"))
            tops[x.shape[1]] = np.concatenate([tops[x.shape[1]], x]) if x.shape[1] in tops else x
    tops = {d: np.unique(x, axis=0).astype(np.float64) for d, x in tops.items() if d}
    tops = {d: x[halved(x)] for d, x in tops.items()}
    handed = spark.sparkContext.broadcast(tops)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in integers.by_length(batch, "vector"):
                x = integers.steps(part.column("vector"))
                cell = np.zeros(len(x), np.int32)
                top = handed.value.get(x.shape[1])
                if top is not None:
                    size = (top * top).sum(1)
                    for low in range(0, len(x), 4096):
                        cell[low : low + 4096] = (size - 2 * (x[low : low + 4096] @ top.T)).argmin(1)
                dim = np.full(len(x), x.shape[1], np.int32)
                packed = pa.array([v.tobytes() for v in x], pa.binary())
                columns = [pa.array(dim), pa.array(cell), part.column("vec_id"), part.column("asks"), packed]
                yield pa.RecordBatch.from_arrays(columns, names=["dim", "cell", "vec_id", "asks", "x"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                have = sum(b.num_rows for b in held)
                same = np.flatnonzero(batch.column("dim").to_numpy()[at:] != (held[0] if held else batch.slice(at)).column("dim")[0].as_py())
                upto = min(batch.num_rows - at, shard - have, int(same[0]) if len(same) else batch.num_rows)
                if upto:
                    held.append(batch.slice(at, upto))
                    at += upto
                if have + upto == shard or len(same) and upto == same[0]:
                    yield _packed(held, number, block)
                    number, held = number + 1, []
        if held:
            yield _packed(held, number, block)

    located = rows.select("vec_id", "asks", "vector").mapInArrow(assign, "dim int, cell int, vec_id bigint, asks boolean, x binary")
    placed = located.repartitionByRange(ranges(spark), "dim", "cell", "vec_id").sortWithinPartitions("dim", "cell", "vec_id")
    return stored(placed.mapInArrow(pack, _SHARDS), "topk-shards")


def _packed(held: list[pa.RecordBatch], number: int, block: int) -> pa.RecordBatch:
    table = pa.Table.from_batches(held)
    dim = table.column("dim")[0].as_py()
    x = np.frombuffer(b"".join(table.column("x").to_pylist()), np.int64).reshape(table.num_rows, dim)
    asks = table.column("asks").to_numpy()
    made = Shard(table.column("vec_id").to_numpy(), asks, _padded(x), block=block)
    row = {"shard": number, "dim": dim, "ids": made.ids.tobytes(), "asks": asks.astype(np.bool_).tobytes()}
    row |= {c: getattr(made, c).astype(np.int64).tobytes() for c in ("x", "high", "low", "first")}
    schema = pa.schema([("shard", pa.int64()), ("dim", pa.int32()), *[(c, pa.binary()) for c in ("ids", "asks", "x", "high", "low", "first")]])
    return pa.RecordBatch.from_pylist([row], schema=schema)


def _asked(index: DataFrame, k: int, block: int) -> DataFrame:
    """(query_id, dim, q, score, last) per query: the k-th result of the shard that holds it."""

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = _shard_of(row, block)
                asks = np.flatnonzero(shard.asks)
                if not len(asks):
                    continue
                best = Best(shard.ids[asks], shard.x[asks], k)
                scan(shard, best, np.arange(len(asks)))
                columns = [
                    pa.array(shard.ids[asks]),
                    pa.array(np.full(len(asks), row["dim"], np.int32)),
                    pa.array([v.tobytes() for v in shard.x[asks]], pa.binary()),
                    pa.array(best.least),
                    pa.array(best.upto),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["query_id", "dim", "q", "score", "last"])

    found = index.mapInArrow(home, "query_id bigint, dim int, q binary, score bigint, last bigint")
    # Of repeated queries the better bound holds for all.
    best = F.min(F.struct(F.bitwise_not("score").alias("s"), "last"))
    one = found.groupBy("query_id", "dim", "q").agg(best.alias("b"))
    return stored(one.select("query_id", "dim", "q", F.bitwise_not("b.s").alias("score"), F.col("b.last").alias("last")), "topk-queries")


def _blocks(asked: DataFrame, most: int) -> Iterator[list[tuple]]:
    """The queries in blocks of at most ``most`` bytes of vectors, one block at a time in the driver."""
    held: list[tuple] = []
    size = 0
    for row in asked.toLocalIterator():
        if held and size + len(row["q"]) > most:
            yield held
            held, size = [], 0
        held.append(tuple(row))
        size += len(row["q"])
    if held:
        yield held


def search(
    vectors: DataFrame,
    queries: Column,
    k: int = 20,
    key: str = "vec_id",
    column: str = "embedding",
    pivots: int = PIVOTS,
    shard: int = SHARD,
    block: int = BLOCK,
    query_bytes: int = QUERY_BYTES,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows for every row that ``queries`` is true for."""
    spark = ready(vectors.sparkSession)
    vector = F.col(f"`{column}`")
    good = integers.usable(vector) & F.col(f"`{key}`").isNotNull()
    rows = vectors.where(good).select(
        F.col(f"`{key}`").cast("bigint").alias("vec_id"),
        F.coalesce(queries, F.lit(False)).alias("asks"),
        vector.cast("array<double>").alias("vector"),
    )
    index = shards(rows, pivots, shard, block)
    found = [_answers(index, part, k, block) for part in _blocks(_asked(index, k, block), query_bytes)]
    if not found:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    out = found[0]
    for other in found[1:]:
        out = out.union(other)
    return out


def _answers(index: DataFrame, asked: list[tuple], k: int, block: int) -> DataFrame:
    """One pass of a block of queries over all shards."""
    spark = index.sparkSession
    by_dim: dict[int, tuple] = {}
    for dim in sorted({a[1] for a in asked}):
        mine = [(i, a) for i, a in enumerate(asked) if a[1] == dim]
        q = np.frombuffer(b"".join(a[2] for _, a in mine), np.int64).reshape(len(mine), -1)
        ids, score, last = (np.array([a[c] for _, a in mine], np.int64) for c in (0, 3, 4))
        by_dim[dim] = (np.array([i for i, _ in mine]), ids, q, score, last)
    handed = spark.sparkContext.broadcast(by_dim)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bests: dict[int, Best] = {}
        for batch in batches:
            for row in batch.to_pylist():
                if row["dim"] not in handed.value:
                    continue
                _, ids, q, score, last = handed.value[row["dim"]]
                best = bests.setdefault(row["dim"], Best(ids, q, k, score, last))
                scan(_shard_of(row, block), best, np.arange(len(ids)))
        for dim, best in bests.items():
            number = handed.value[dim][0]
            at, place = np.nonzero(best.ids != _LAST)
            yield pa.RecordBatch.from_arrays(
                [pa.array(number[at]), pa.array(best.own[at]), pa.array(best.ids[at, place]), pa.array(best.scores[at, place])],
                names=["number", "query_id", "vec_id", "score"],
            )

    found = index.mapInArrow(answer, "number bigint, query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("number").orderBy(F.desc("score"), F.asc("vec_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return stored(ranked.select("query_id", "rank", "vec_id", "score"), "topk-found")
