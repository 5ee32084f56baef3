"""Exact threshold pairs of embeddings by dual traversal of cover trees.

Vectors are brought to unit length, so that cosine >= c means distance <= eps with
eps ** 2 = 2 - 2 c, and the triangle inequality holds.

1. Equal vectors are one point with a weight. The points of one length are the root of a tree.
2. A node of more than BLOCK_ROWS points is split: a tree of about SAMPLE of its points, chosen
   by hash, with radii halving per level, gives centres; every point goes to its nearest centre.
   A centre, its points and their largest distance are a cell. Cells, in tree order, are put
   together to children of at most BLOCK_ROWS points; a larger cell is a child of its own and
   split again, so that nodes nest level by level. Points that lie all at one place, which
   no centres tell apart, are cut by hash.
3. Node pairs go down level by level, from the pair of a root with itself, as joins: a pair is
   replaced by the pairs of children of which two cells may hold a link:
   distance of centres <= both covering radii + eps.
4. Each block (a node that is not split) builds the rest of its tree: nested levels with
   halving radii down to single points. The trees of a pair of blocks left by step 3 are
   traversed together; a pair of nodes is dropped if its distance exceeds both radii + eps,
   accepted whole if distance + both radii <= eps, else its children are compared.

Nodes, pairs and trees are tables; only whether a level has nodes to split reaches the driver.

Accepted node pairs add to link counts without listing pairs. For the classes a task emits
a spanning forest of what it linked, at most one edge per point.

In directions spread evenly over many dimensions no bound separates cells, and the number
of block pairs grows with the square of the points; that is the price of exact pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlane.llm.graph import components
from ledgerlane.llm.jobs import ready, stored

#: Points that the centres of a node come from, on average (chosen by hash).
SAMPLE = 1024
#: Points of a block, at most.
BLOCK_ROWS = 8192
#: Points packed in one row to be assigned to centres.
CHUNK = 512
#: Allowance for rounding in bounds; pairs within it are decided by their own cosine.
SLACK = 1e-9
#: Child pairs whose distances are computed at once.
AT_ONCE = 1 << 22


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances between unit vectors."""
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


def net(x: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Greedy net: centres (row numbers) more than ``radius`` apart, and each row's centre number."""
    centres: list[int] = []
    own = np.full(len(x), -1)
    for low in range(0, len(x), 256):
        rows = np.arange(low, min(low + 256, len(x)))
        for c in range(0, len(centres), 8192):
            part = centres[c : c + 8192]
            d = distances(x[rows], x[part])
            near = d.argmin(1)
            hit = (d[np.arange(len(rows)), near] <= radius) & (own[rows] < 0)
            own[rows[hit]] = c + near[hit]
        rest = rows[own[rows] < 0]
        if not len(rest):
            continue
        d = distances(x[rest], x[rest])
        for i, row in enumerate(rest):
            if own[row] < 0:
                own[rest[(own[rest] < 0) & (d[i] <= radius)]] = len(centres)
                own[row] = len(centres)
                centres.append(int(row))
    return np.array(centres, np.int64), own


class Tree:
    """A block's cover tree in flat arrays; ``x`` is in tree order.

    Node u: centre row ``centre[u]``, rows ``low[u] : high[u]``, covering radius ``radius[u]``,
    children ``child[u] : child[u] + children[u]``.
    """

    FIELDS = ("centre", "low", "high", "radius", "child", "children")

    def __init__(self, x: np.ndarray, **arrays: np.ndarray) -> None:
        self.x = x
        for f in self.FIELDS:
            setattr(self, f, arrays[f])

    @classmethod
    def build(cls, x: np.ndarray) -> tuple[Tree, np.ndarray]:
        """The tree and the order of the given rows in it."""
        centre, low, high, radius, child, children = [[0] for _ in range(6)]
        order = np.arange(len(x))
        high[0] = len(x)
        todo = [(0, 2.0)]
        at = 0
        while at < len(todo):
            u, reach = todo[at]
            at += 1
            rows = order[low[u] : high[u]].copy()
            spread = distances(x[rows], x[[centre[u]]])[:, 0]
            radius[u] = float(spread.max(initial=0.0))
            if len(rows) == 1 or radius[u] <= SLACK:
                continue
            # Levels at which the node would be its own only child are left out.
            reach = min(reach, radius[u]) / 2
            centres, own = net(x[rows], reach)
            by = np.argsort(own, kind="stable")
            order[low[u] : high[u]] = rows[by]
            bounds = low[u] + np.concatenate([[0], np.cumsum(np.bincount(own, minlength=len(centres)))])
            child[u], children[u] = len(centre), len(centres)
            for c, a, b in zip(rows[centres], bounds[:-1], bounds[1:], strict=True):
                todo.append((len(centre), reach))
                centre.append(int(c))
                low.append(int(a))
                high.append(int(b))
                radius.append(0.0)
                child.append(0)
                children.append(0)
        place = np.empty(len(x), np.int64)
        place[order] = np.arange(len(x))
        arrays = {
            "centre": place[np.array(centre)],
            "low": np.array(low),
            "high": np.array(high),
            "radius": np.array(radius, float),
            "child": np.array(child),
            "children": np.array(children),
        }
        return cls(x[order], **arrays), order


class Links:
    """Link counts and a spanning forest of the rows of two blocks (the second behind the first)."""

    def __init__(self, weight_a: np.ndarray, weight_b: np.ndarray | None) -> None:
        self.same = weight_b is None
        self.offset = 0 if self.same else len(weight_a)
        weights = weight_a if self.same else np.concatenate([weight_a, weight_b])
        self.sum = np.concatenate([[0], np.cumsum(weights)])
        self.step = np.zeros(len(weights) + 1, np.int64)
        self.parent = np.arange(len(weights))

    def count(self, low: int, high: int, other_low: int, other_high: int) -> None:
        """Rows low : high each link with all rows of the other range."""
        more = self.sum[other_high] - self.sum[other_low]
        self.step[low] += more
        self.step[high] -= more

    def find(self, i: int) -> int:
        p = self.parent
        while p[i] != i:
            p[i] = p[p[i]]
            i = p[i]
        return int(i)

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        if i != j:
            self.parent[max(i, j)] = min(i, j)

    def whole(self, low: int, high: int, other_low: int, other_high: int) -> None:
        """All pairs between two ranges link."""
        self.count(low, high, other_low, other_high)
        if (low, high) != (other_low, other_high):
            self.count(other_low, other_high, low, high)
        else:
            # A row does not link with itself.
            own = np.diff(self.sum[low : high + 1])
            self.step[low:high] -= own
            self.step[low + 1 : high + 1] += own
        for i in range(low, high):
            self.join(other_low, i)
        for j in range(other_low, other_high):
            self.join(low, j)

    def pairs(self, i: np.ndarray, j: np.ndarray) -> None:
        np.add.at(self.step, i, self.sum[j + 1] - self.sum[j])
        np.add.at(self.step, i + 1, self.sum[j] - self.sum[j + 1])
        np.add.at(self.step, j, self.sum[i + 1] - self.sum[i])
        np.add.at(self.step, j + 1, self.sum[i] - self.sum[i + 1])
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            self.join(a, b)

    def counts(self) -> np.ndarray:
        return np.cumsum(self.step)[:-1]


def _expanded(tree: Tree, nodes: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The nodes, those in ``which`` replaced by their children."""
    open_ = nodes[which]
    count = tree.children[open_]
    inside = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    return np.concatenate([nodes[~which], np.repeat(tree.child[open_], count) + inside])


def traverse(a: Tree, b: Tree, links: Links, least: float) -> None:
    """All pairs with cosine >= ``least`` between two trees, or within one if ``a is b``.

    A node of the first tree is met with all nodes of the second that are left for it at
    once, so that the number of steps follows the nodes, not the node pairs. Within one
    tree the second node never comes before the first in tree order.
    """
    eps = float(np.sqrt(max(2 - 2 * least, 0.0)))
    same = a is b
    todo = [(0, np.array([0]))]
    off = links.offset
    while todo:
        u, vs = todo.pop()
        kids = np.arange(a.child[u], a.child[u] + a.children[u]) if a.children[u] else np.array([u])
        own = vs == u if same else np.zeros(len(vs), bool)
        vs = _expanded(b, vs, (b.children[vs] > 0) & (own | (a.children[u] == 0) | (b.radius[vs] >= a.radius[u] / 2)))
        step = max(1, AT_ONCE // len(vs))
        for low in range(0, len(kids), step):
            part = kids[low : low + step]
            d = distances(a.x[a.centre[part]], b.x[b.centre[vs]])
            reach = a.radius[part][:, None] + b.radius[vs][None, :]
            open_ = d <= reach + (eps + SLACK)
            if same:
                open_ &= a.low[part][:, None] <= b.low[vs][None, :]
            i, j = np.nonzero(open_)
            d, reach = d[i, j], reach[i, j]
            i, j = part[i], vs[j]
            single = (a.high[i] - a.low[i] == 1) & (b.high[j] - b.low[j] == 1)
            # Single rows are decided by their own cosine.
            whole = (d + reach <= eps - SLACK) & ~single
            for p, q in zip(i[whole].tolist(), j[whole].tolist(), strict=True):
                links.whole(a.low[p], a.high[p], b.low[q] + off, b.high[q] + off)
            pair = single & (i != j) if same else single
            if pair.any():
                x, y = a.low[i[pair]], b.low[j[pair]]
                good = np.einsum("ij,ij->i", a.x[x], b.x[y]) >= least
                links.pairs(x[good], y[good] + off)
            rest = ~whole & ~single
            closed = rest & (a.children[i] == 0) & (b.children[j] == 0)
            for p, q in zip(i[closed].tolist(), j[closed].tolist(), strict=True):
                _rows(a, b, p, q, links, least, same)
            i, j = i[rest & ~closed], j[rest & ~closed]
            bounds = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1], [True]])) if len(i) else []
            todo += [(int(i[x]), j[x:y]) for x, y in zip(bounds[:-1], bounds[1:], strict=True)]


def _rows(a: Tree, b: Tree, u: int, v: int, links: Links, least: float, same: bool) -> None:
    """Two childless nodes, row by row; their rows lie at one place each but for rounding."""
    rows_u, rows_v = np.arange(a.low[u], a.high[u]), np.arange(b.low[v], b.high[v])
    i, j = np.nonzero(a.x[rows_u] @ b.x[rows_v].T >= least)
    i, j = rows_u[i], rows_v[j]
    if same and u == v:
        i, j = i[i < j], j[i < j]
    links.pairs(i, j + links.offset)


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of equal lengths."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), x.ravel())


def _units(x: np.ndarray) -> np.ndarray:
    """Rows brought to unit length."""
    # Scaled by a power of two first, which is exact, so that squares of very large or small components stay finite.
    x = np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _runs(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Stretches of rows of one node, which is the first column."""
    node = batch.column(0).to_pylist()
    low = 0
    for i in range(1, len(node) + 1):
        if i == len(node) or node[i] != node[low]:
            yield batch.slice(low, i - low)
            low = i


def centres_of(sample: np.ndarray, size: int, rows: int) -> np.ndarray:
    """Centres for a node of ``size`` points from a sample of them, in tree order.

    Nodes of the sample's tree that stand for at most an eighth of ``rows`` points, or for points at one place.
    """
    tree, _ = Tree.build(sample)
    out, todo = [], [0]
    while todo:
        u = todo.pop()
        if tree.children[u] == 0 or (u and (tree.high[u] - tree.low[u]) * size <= rows / 8 * len(sample)):
            out.append(tree.centre[u])
        else:
            todo += range(tree.child[u] + tree.children[u] - 1, tree.child[u] - 1, -1)
    return tree.x[out]


def children_of(counts: list[int], rows: int) -> list[list[int]]:
    """Cells (numbers, in tree order) of each child: at most ``rows`` points, or one larger cell."""
    out: list[list[int]] = []
    room = -1
    for cell, n in enumerate(counts):
        if n > room:
            out.append([])
            room = rows
        out[-1].append(cell)
        room -= n
        if n > rows:
            room = -1
    return out


#: A node's children by their cells: cell k, of radius far[k] around row k of ``centres``, belongs to
#: child[k], which holds size[k] points; of a block, itself is the only child.
_FAMILY = (
    "node string, block boolean, child array<string>, size array<bigint>, cell array<int>, parts array<int>, "
    "far array<double>, centres binary"
)


def _families(rows: int):
    """From (node, cells, centres): the row of each split node, and one for each of its children that is a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for node, cells, data in zip(*[batch.column(c).to_pylist() for c in ("node", "cells", "centres")], strict=True):
                cells = sorted(cells, key=lambda c: c["cell"])
                total = sum(c["n"] for c in cells)
                numbers = [c["cell"] for c in cells]
                # All rows of one centre's matrix are read; centres without points have no cell.
                x = np.frombuffer(data, np.float64).reshape(_count(data, int(node.split("/")[0])), -1)[numbers]
                family = {"node": node, "block": False, "child": [], "size": [], "cell": [], "parts": [], "far": [], "centres": x.tobytes()}
                for k, group in enumerate(children_of([c["n"] for c in cells], rows)):
                    size = sum(cells[c]["n"] for c in group)
                    parts = -(-total // rows) if len(cells) == 1 else 1
                    name = f"{node}/{k}"
                    for c in group:
                        for f, v in (("child", name), ("size", size), ("cell", numbers[c]), ("parts", parts), ("far", cells[c]["far"])):
                            family[f].append(v)
                    if parts == 1 and size > rows:
                        continue
                    for part in range(parts):
                        own = name if parts == 1 else f"{name}/{part}"
                        n = len(group)
                        out.append(
                            {"node": own, "block": True, "child": [own] * n, "size": [0] * n, "cell": [numbers[c] for c in group]}
                            | {"parts": [1] * n, "far": [cells[c]["far"] for c in group], "centres": x[group].tobytes()}
                        )
                out.append(family)
            yield pa.RecordBatch.from_pylist(out, schema=_FAMILY_SCHEMA)

    return run


_FAMILY_SCHEMA = pa.schema(
    [
        ("node", pa.string()),
        ("block", pa.bool_()),
        ("child", pa.list_(pa.string())),
        ("size", pa.list_(pa.int64())),
        ("cell", pa.list_(pa.int32())),
        ("parts", pa.list_(pa.int32())),
        ("far", pa.list_(pa.float64())),
        ("centres", pa.binary()),
    ]
)


def _count(data: bytes, dim: int) -> int:
    return len(data) // (8 * dim)


def _members(row: dict, side: str, rows: int) -> tuple[list[str], list[bool], np.ndarray, np.ndarray, np.ndarray]:
    """Of a family: children's names, whether each is to be split, and per cell its child's number, centre and radius."""
    names, split, first = [], [], {}
    owner, where = [], []
    for k, (child, size, parts) in enumerate(zip(*[row[f"{f}_{side}"] for f in ("child", "size", "parts")], strict=True)):
        if child not in first:
            first[child] = len(names)
            names += [child] if parts == 1 else [f"{child}/{p}" for p in range(parts)]
            split += [parts == 1 and size > rows] * parts
        owner += range(first[child], first[child] + parts)
        where += [k] * parts
    far = np.array(row[f"far_{side}"])
    x = np.frombuffer(row[f"centres_{side}"], np.float64).reshape(len(far), -1)
    return names, split, np.array(owner), x[where], far[where]


def _deeper(rows: int, least: float):
    """Pairs of children (i, j, open) that may hold a linked pair; open if one of them is split again."""
    eps = float(np.sqrt(max(2 - 2 * least, 0.0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                names, split, owner, x, far = _members(row, "i", rows)
                others, splits, others_owner, y, fars = _members(row, "j", rows)
                near = np.zeros((len(names), len(others)), bool)
                a, b = np.nonzero(distances(x, y) <= far[:, None] + fars[None, :] + (eps + 2 * SLACK))
                near[owner[a], others_owner[b]] = True
                if row["i"] == row["j"]:
                    np.fill_diagonal(near, True)
                    near = np.triu(near)
                a, b = np.nonzero(near)
                open_ = np.array(split, bool)[a] | np.array(splits, bool)[b]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([names[i] for i in a], pa.string()), pa.array([others[j] for j in b], pa.string()), pa.array(open_)],
                    names=["i", "j", "open"],
                )

    return run


_POINT = "node string, size bigint, point bigint, weight bigint, vector array<double>"


def near_duplicates(
    vectors: DataFrame, least: float = 0.9, key: str = "vec_id", column: str = "embedding", rows: int = BLOCK_ROWS
) -> DataFrame:
    """(``key``, n_links, component_id) of every row.

    ``n_links`` counts the other rows linked directly, copies included; ``component_id`` is
    the least key reachable by links, the row's own included. Vectors that are null, empty,
    zero or hold null or non-finite components link with nothing. Vectors of different lengths
    do not link; each length is a tree of its own. Keys must be integers; rows without key take
    part, and a class of such rows alone has no component_id. Rows that share a key are rows
    of their own. An empty table gives no rows; other columns are not read.
    """
    ready(vectors.sparkSession)
    v = F.col("vector")
    source = vectors.select(F.col(f"`{key}`").cast("bigint").alias("key"), F.col(f"`{column}`").cast("array<double>").alias("vector"))
    good = (
        v.isNotNull()
        & (F.size(v) > 0)
        & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists(v, lambda x: x != 0)
    )
    # A null component makes the condition null.
    good = F.coalesce(good, F.lit(False))
    usable = source.where(good)
    alone = source.where(~good).select("key", F.lit(0).cast("bigint").alias("n_links"), F.col("key").alias("component_id"))
    classes = _classes(usable, least, rows)
    kept = usable.join(classes, "vector").select("key", "n_links", "component_id")
    return kept.union(alone).withColumnRenamed("key", key)


def _classes(source: DataFrame, least: float, rows: int) -> DataFrame:
    """(vector, n_links, component_id) of the distinct vectors."""
    points = source.groupBy("vector").agg(F.min("key").alias("least"), F.count("*").alias("weight"))
    # Points are numbered once, in the written table.
    points = stored(points.select(F.monotonically_increasing_id().alias("point"), "least", "weight", "vector"), "cover-points")
    placed, pairs = _blocks(points, least, rows)
    found = _compare(placed, pairs, least)
    counted = found.where("n is not null").groupBy(F.col("a").alias("point")).agg(F.sum("n").alias("n"))
    linked = found.where("b is not null").select("a", "b")
    rooted = points.select("point", "least", "weight", "vector")
    roots = components(linked).withColumnRenamed("node", "point")
    rooted = rooted.join(counted, "point", "left").join(roots, "point", "left")
    rooted = rooted.withColumn("root", F.coalesce("root", "point")).withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))
    rooted = stored(rooted, "cover-roots")
    firsts = stored(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "cover-firsts")
    classes = rooted.join(firsts, "root").select("vector", (F.col("n") + F.col("weight") - 1).alias("n_links"), "component_id")
    return stored(classes, "cover-classes")


def _blocks(points: DataFrame, least: float, rows: int) -> tuple[DataFrame, DataFrame]:
    """Rows (block, point, weight, vector) of the blocks, vectors of unit length, and the pairs (i, j) of blocks to compare."""
    length = F.size("vector").cast("string")
    roots = stored(points.groupBy(length.alias("node")).agg(F.count("*").alias("size")), "cover-roots")

    def scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in _runs(batch):
                columns = [*run.columns[:4], _lists(_units(_matrix(run.column(4))))]
                yield pa.RecordBatch.from_arrays(columns, names=run.schema.names)

    numbered = points.select(length.alias("node"), "point", "weight", "vector").join(roots, "node")
    numbered = numbered.select("node", "size", "point", "weight", "vector").sortWithinPartitions("node")
    held = numbered.mapInArrow(scaled, _POINT)
    small = F.col("size") <= rows
    placed = held.where(small).select(F.col("node").alias("block"), "point", "weight", "vector")
    pairs = roots.where(small).select(F.col("node").alias("i"), F.col("node").alias("j"))
    wanted = roots.where(~small).select(F.col("node").alias("i"), F.col("node").alias("j"))
    blocks = None
    open_points, level = held.where(~small), 0
    while not wanted.isEmpty():
        families, cells = _split(open_points, rows, level)
        nodes = families if blocks is None else families.union(blocks)
        left = nodes.drop("block").withColumnsRenamed({c: f"{c}_i" for c in nodes.columns}).withColumnRenamed("node_i", "i")
        right = nodes.drop("block").withColumnsRenamed({c: f"{c}_j" for c in nodes.columns}).withColumnRenamed("node_j", "j")
        # Blocks found at this level are no parents of it: pairs name nodes of the level above.
        deeper = wanted.join(left, "i").join(right, "j").mapInArrow(_deeper(rows, least), "i string, j string, open boolean")
        deeper = stored(deeper, "cover-pairs")
        pairs = pairs.union(deeper.where("not open").select("i", "j"))
        wanted = deeper.where("open").select("i", "j")
        blocks = families.where("block") if blocks is None else blocks.union(families.where("block"))
        where = families.where("not block").select(
            "node", F.explode(F.arrays_zip("cell", "child", "size", "parts")).alias("to")
        ).select("node", "to.*")
        name = F.when(F.col("parts") == 1, F.col("child")).otherwise(F.concat_ws("/", "child", F.pmod(F.xxhash64("point"), "parts")))
        moved = cells.join(where, ["node", "cell"]).select(
            name.alias("node"), "size", "point", "weight", "vector", ((F.col("parts") > 1) | small).alias("block")
        )
        moved = stored(moved, "cover-nodes")
        placed = placed.union(moved.where("block").select(F.col("node").alias("block"), "point", "weight", "vector"))
        open_points, level = moved.where("not block").drop("block"), level + 1
    return placed, pairs


def _split(held: DataFrame, rows: int, level: int) -> tuple[DataFrame, DataFrame]:
    """One level of nodes split: their families, and their points as (node, cell, far, point, weight, vector)."""
    even = F.pmod(F.xxhash64("point", F.lit(level)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    sample = held.where(even * F.col("size") < SAMPLE).select("node", "size", "point", "vector")

    def choose(table: pa.Table) -> pa.Table:
        table = table.sort_by("point")
        x = centres_of(_matrix(table.column("vector")), table.column("size")[0].as_py(), rows)
        return pa.table({"node": table.column("node")[:1], "centres": pa.array([x.tobytes()], pa.binary())})

    centres = stored(sample.groupBy("node").applyInArrow(choose, "node string, centres binary"), "cover-centres")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for run in _runs(batch):
                for low in range(0, run.num_rows, CHUNK):
                    part = run.slice(low, CHUNK)
                    columns = [part.column(c).to_numpy().tobytes() for c in ("point", "weight")]
                    out.append((part.column("node")[0].as_py(), *columns, _matrix(part.column("vector")).tobytes()))
            names = ["node", "points", "weights", "x"]
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], schema=_CHUNK_SCHEMA)

    chunks = held.sortWithinPartitions("node").mapInArrow(pack, "node string, points binary, weights binary, x binary")

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                point, weight = np.frombuffer(row["points"], np.int64), np.frombuffer(row["weights"], np.int64)
                x = np.frombuffer(row["x"], np.float64).reshape(len(point), -1)
                d = distances(x, np.frombuffer(row["centres"], np.float64).reshape(-1, x.shape[1]))
                columns = [pa.array([row["node"]] * len(x)), pa.array(d.argmin(1).astype(np.int32)), pa.array(d.min(1))]
                columns += [pa.array(point), pa.array(weight), _lists(x)]
                yield pa.RecordBatch.from_arrays(columns, names=["node", "cell", "far", "point", "weight", "vector"])

    kind = "node string, cell int, far double, point bigint, weight bigint, vector array<double>"
    cells = stored(chunks.join(centres, "node").mapInArrow(assign, kind), "cover-cells")
    counts = cells.groupBy("node", "cell").agg(F.count("*").alias("n"), F.max("far").alias("far"))
    counts = counts.groupBy("node").agg(F.collect_list(F.struct("cell", "n", "far")).alias("cells"))
    families = stored(counts.join(centres, "node").mapInArrow(_families(rows), _FAMILY), "cover-families")
    return families, cells


def _compare(placed: DataFrame, wanted: DataFrame, least: float) -> DataFrame:
    """Rows (a, n, null): links of point a; rows (a, null, b): edges of the spanning forests."""

    def build(table: pa.Table) -> pa.Table:
        tree, order = Tree.build(_matrix(table.column("vector")))
        columns = {"block": table.column("block")[0].as_py(), "points": table.column("point").to_numpy()[order].tobytes()}
        columns["weights"] = table.column("weight").to_numpy()[order].tobytes()
        columns["x"] = tree.x.tobytes()
        for f in Tree.FIELDS:
            columns[f] = getattr(tree, f).tobytes()
        return pa.Table.from_pylist([columns], schema=_block_schema())

    trees = stored(placed.groupBy("block").applyInArrow(build, _block_ddl()), "cover-trees")
    left = trees.withColumnsRenamed({c: f"{c}_i" for c in trees.columns}).withColumnRenamed("block_i", "i")
    right = trees.withColumnsRenamed({c: f"{c}_j" for c in trees.columns}).withColumnRenamed("block_j", "j")
    both = wanted.join(left, "i").join(right, "j")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                ta, points_a, weights_a = _load(row, "i")
                if row["i"] == row["j"]:
                    tb, points, links = ta, points_a, Links(weights_a, None)
                else:
                    tb, points_b, weights_b = _load(row, "j")
                    points, links = np.concatenate([points_a, points_b]), Links(weights_a, weights_b)
                traverse(ta, tb, links, least)
                n = links.counts()
                some = np.flatnonzero(n > 0)
                child = np.flatnonzero(links.parent != np.arange(len(points)))
                up = np.array([links.find(int(i)) for i in child], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([points[some], points[up]])),
                        pa.array([*n[some].tolist(), *[None] * len(child)], pa.int64()),
                        pa.array([*[None] * len(some), *points[child].tolist()], pa.int64()),
                    ],
                    names=["a", "n", "b"],
                )

    return stored(both.mapInArrow(compare, "a bigint, n bigint, b bigint"), "cover-links")


_CHUNK_SCHEMA = pa.schema([("node", pa.string()), *[(c, pa.binary()) for c in ("points", "weights", "x")]])


def _block_schema() -> pa.Schema:
    return pa.schema([("block", pa.string()), *[(c, pa.binary()) for c in ("points", "weights", "x", *Tree.FIELDS)]])


def _block_ddl() -> str:
    return "block string, " + ", ".join(f"{c} binary" for c in ("points", "weights", "x", *Tree.FIELDS))


def _load(row: dict, side: str) -> tuple[Tree, np.ndarray, np.ndarray]:
    points = np.frombuffer(row[f"points_{side}"], np.int64)
    arrays = {f: np.frombuffer(row[f"{f}_{side}"], np.float64 if f == "radius" else np.int64) for f in Tree.FIELDS}
    x = np.frombuffer(row[f"x_{side}"], np.float64).reshape(len(points), -1)
    return Tree(x, **arrays), points, np.frombuffer(row[f"weights_{side}"], np.int64)
