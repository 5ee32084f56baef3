"""N-gram Jaccard join: linked documents and their classes, exactly.

A document's set is the distinct 64-bit hashes of its word n-grams (all words as one
n-gram where there are fewer). Two documents link when the Jaccard similarity of their
sets is at least ``num / den``; a class is what links connect.

1. Equal sets are one node, named by a hash of the set.
2. Size-banded tiles. Linked sets lie in one size band or in neighbouring ones. Within a
   band the hash range is cut into more segments than a linked pair can have differences,
   so a linked pair agrees in whole segments. A tile is a band, a segment and its content.
   Each set may leave out its most frequent tiles, as many as there are spare segments.
3. In every tile the least member is paired with the others. A pair is checked by hashed
   bitmap signatures first: the bits set in one and not in the other bound the overlap
   from above. What may pass is intersected exactly, as sorted arrays.
4. Links are connected. Where components meet in a tile, one member of each is paired, as in
   step 3. Tiles whose members are still not all connected are compared fully, in blocks of
   bounded size: bitmaps of members of different components, then exact intersection.
   Pairs whose bitmaps rule a link out are never emitted.

Entries travel as packed arrays; a tile with a third of all sets has one entry per set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlane.llm import packed as P
from ledgerlane.llm import words as W
from ledgerlane.llm.graph import components
from ledgerlane.llm.jobs import ready, stored, tidy

_U = np.uint64
#: Sets per packed block of tile entries; their number fits the 15 low bits of an entry.
BLOCK_SETS = 1 << 15
#: Members of a tile compared with each other in one task; larger tiles are cut into blocks.
TILE_SETS = 4096


def shingle_sets(found: W.Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes sorted within each text, first): the set of text t is hashes[first[t] : first[t + 1]]."""
    counts = found.counts
    hashes = found.hashes()
    starts = W.gram_starts(found.first, n)
    text = found.text_of()
    short = np.flatnonzero((counts > 0) & (counts < n))
    parts, owners = [W.grams(hashes, n)[starts]], [text[starts]]
    for t in short:
        parts.append(W.grams(hashes[found.first[t] : found.first[t + 1]], int(counts[t])))
        owners.append(np.array([t]))
    value, owner = np.concatenate(parts), np.concatenate(owners).astype(np.int64)
    order = np.argsort(value)
    value, owner = value[order], owner[order]
    # A stable sort of small integers is a radix sort.
    order = np.argsort(owner.astype(np.uint16) if len(counts) < 1 << 16 else owner, kind="stable")
    value, owner = value[order], owner[order]
    keep = np.ones(len(value), bool)
    keep[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[keep], owner[keep]
    return value, np.searchsorted(owner, np.arange(len(counts) + 1))


class Bands:
    """Size bands for a threshold: linked sets lie in one band or in neighbouring ones.

    Index i serves pairs with the smaller set in band i and the other in band i or i + 1.
    ``segments[i]`` is one more than the largest number of n-grams in which such a pair can
    differ, so that cutting the hash range into so many segments leaves one without a difference.
    """

    def __init__(self, num: int, den: int) -> None:
        self.num, self.den = num, den
        lows = [1]
        while lows[-1] < 1 << 31:
            lows.append(lows[-1] * den // num + 1)
        self.low = np.array(lows, np.int64)
        top = self.low[1:-1] - 1  # largest size in band i
        largest = np.minimum(top * den // num, self.low[2:] - 1)
        self.segments = (top + largest) * (den - num) // (den + num) + 1

    def of(self, size: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.low, size, "right") - 1


def tile_keys(
    value: np.ndarray, first: np.ndarray, bands: Bands
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tiles of every set: (key, owner, back) per tile, and per set and back how many it may skip.

    The tiles of an index are its segments, ``spare`` more than the pigeonhole needs, so a
    linked pair shares at least spare + 1 of them. Put in any common order, the last of
    the shared ones has ``spare`` others before it in both sets: each set may skip its
    first ``spare`` tiles. Empty segments come first in that order; a set with fewer
    of them than it may skip emits none.
    """
    sizes = np.diff(first)
    band = bands.of(np.maximum(sizes, 1))
    owner = np.repeat(np.arange(len(sizes)), sizes)
    weight = W.mix(value ^ _U(0xA24BAED4963EE407))
    keys, owners, backs = [np.zeros(0, _U)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    skips = np.zeros((len(sizes), 2), np.uint8)
    for back in (0, 1):
        index = band - back
        use = np.flatnonzero((index >= 0) & (sizes > 0))
        if not len(use):
            continue
        extra = np.zeros(len(sizes), np.int64)
        extra[use] = spare(index[use], bands)
        count = np.zeros(len(sizes), np.int64)
        count[use] = bands.segments[index[use]] + extra[use]
        pick = count[owner] > 0
        v, o, w = value[pick], owner[pick], weight[pick]
        # Hashes are sorted within a set, so a segment of the hash range is a stretch of it.
        segment = ((v >> _U(32)) * count[o].astype(_U) >> _U(32)).astype(np.int64)
        new = np.ones(len(v), bool)
        new[1:] = (segment[1:] != segment[:-1]) | (o[1:] != o[:-1])
        at = np.flatnonzero(new)
        content = np.add.reduceat(w, at)
        tag = (index[o[at]].astype(_U) << _U(40)) + segment[at].astype(_U)
        keys.append(W.mix(content ^ W.mix(tag + _U(1))))
        owners.append(o[at])
        backs.append(np.full(len(at), back))
        filled = np.bincount(o[at], minlength=len(sizes))
        empty = count - filled
        skips[use, back] = np.maximum(extra - empty, 0)[use]
        for t in np.flatnonzero(empty > extra):
            absent = np.setdiff1d(np.arange(count[t]), segment[o == t])[extra[t] :]
            keys.append(W.mix(W.mix((_U(index[t]) << _U(40)) + absent.astype(_U) + _U(1))))
            owners.append(np.full(len(absent), t))
            backs.append(np.full(len(absent), back))
    return np.concatenate(keys), np.concatenate(owners), np.concatenate(backs), skips


def set_id(value: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set; equal sets have equal names."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(W.mix(value + np.uint64(0x9E37)), dtype=np.uint64)])
    sums = total[first[1:]] - total[first[:-1]]
    return W.mix(sums ^ (np.diff(first).astype(np.uint64) << np.uint64(40)))


def spare(index: np.ndarray, bands: Bands) -> np.ndarray:
    """Segments beyond those needed, per index: so many of a set's tiles need not be compared."""
    return np.minimum(1 + (bands.segments[index] - 1) // 4, 255)


def _entries(docs: DataFrame, n: int, bands: Bands) -> DataFrame:
    """Packed tile entries of the distinct sets of each task: (range, entries, names, skips).

    An entry is 48 bits of the tile's key and the set's number in the block with ``back``.
    """
    count = P.ranges(docs.sparkSession)
    names = ["range", "entries", "names", "skips"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, _, found in W.word_pieces(batch.column(0), W.spaced(), lower=True):
                value, first = shingle_sets(found, n)
                name = set_id(value, first)
                fresh = []
                for t, x in enumerate(name.tolist()):
                    if first[t] < first[t + 1] and x not in seen:
                        seen.add(x)
                        fresh.append(t)
                if len(seen) > 1 << 20:
                    seen.clear()
                for low in range(0, len(fresh), BLOCK_SETS):
                    block = np.array(fresh[low : low + BLOCK_SETS])
                    keep = np.zeros(len(name), bool)
                    keep[block] = True
                    sizes = np.diff(first)
                    own = value[np.repeat(keep, sizes)]
                    own_first = np.concatenate([[0], np.cumsum(sizes[block])])
                    key, owner, back, skips = tile_keys(own, own_first, bands)
                    entry = key << _U(16) | (owner << 1 | back).astype(_U)
                    rows = []
                    for r, at in P.cut(key, count):
                        rows.append((r, entry[at].tobytes(), name[block].tobytes(), skips.tobytes()))
                    yield P.row_batch(rows, names)

    return docs.select(F.col("text")).mapInArrow(tidy(run), P.schema(names))


def _shared_tiles(entries: DataFrame) -> DataFrame:
    """Packed members of tiles with two sets or more, by set: (range, set, tile, count, back, skip)."""
    count = P.ranges(entries.sparkSession)
    names = ["range", "set", "tile", "size", "back", "skip"]

    def work(columns: dict[str, list[bytes]], r: int) -> Iterator[pa.RecordBatch]:
        parts = []
        for e, n, s in zip(columns["entries"], columns["names"], columns["skips"], strict=True):
            e = np.frombuffer(e, _U)
            own = (e & _U(0xFFFF)).astype(np.int64)
            skip = np.frombuffer(s, np.uint8).reshape(-1, 2)
            parts.append((e >> _U(16), np.frombuffer(n, _U)[own >> 1], (own & 1).astype(np.uint8), skip[own >> 1, own & 1]))
        # Nothing is held twice: neither the bytes received nor the parts are needed any more.
        columns.clear()
        tile, name, back, skip = (np.concatenate(x) for x in zip(*parts, strict=True))
        parts.clear()
        order = np.argsort(tile, kind="stable")
        tile = tile[order]
        same = np.concatenate([[False], tile[1:] == tile[:-1]]) if len(tile) else np.zeros(0, bool)
        shared = same | np.append(same[1:], False)
        order, tile = order[shared], tile[shared]
        name, back, skip = name[order], back[order], skip[order]
        # One entry per set and tile: copies of a set come from many tasks.
        order = np.lexsort((name, tile))
        tile, name, back, skip = tile[order], name[order], back[order], skip[order]
        keep = np.ones(len(tile), bool)
        keep[1:] = (tile[1:] != tile[:-1]) | (name[1:] != name[:-1])
        tile, name, back, skip = tile[keep], name[keep], back[keep], skip[keep]
        _, inverse, size = np.unique(tile, return_inverse=True, return_counts=True)
        size = size[inverse]
        many = size > 1
        tile, name, back, skip, size = tile[many], name[many], back[many], skip[many], size[many].astype(np.uint32)
        tile = W.mix(tile + (_U(r) << _U(48)))
        rows = [
            (q, name[at].tobytes(), tile[at].tobytes(), size[at].tobytes(), back[at].tobytes(), skip[at].tobytes())
            for q, at in P.cut(name, count)
        ]
        yield P.row_batch(rows, names)

    return P.reduce_ranges(entries, tidy(work), P.schema(names))


def _needed_tiles(members: DataFrame) -> DataFrame:
    """(tile, node) without the tiles a set may skip: its most frequent ones."""

    def work(columns: dict[str, list[bytes]], _: int) -> Iterator[pa.RecordBatch]:
        name, tile = P.joined(columns["set"], _U), P.joined(columns["tile"], _U)
        size = P.joined(columns["size"], np.uint32).astype(np.int64)
        back, skip = P.joined(columns["back"], np.uint8), P.joined(columns["skip"], np.uint8)
        columns.clear()
        order = np.lexsort((tile, -size, back, name))
        name, tile, back, skip = name[order], tile[order], back[order], skip[order]
        new = np.ones(len(name), bool)
        new[1:] = (name[1:] != name[:-1]) | (back[1:] != back[:-1])
        at = np.arange(len(name))
        place = at - np.maximum.accumulate(np.where(new, at, 0))
        keep = place >= skip
        yield pa.RecordBatch.from_arrays(
            [pa.array(tile[keep].view(np.int64)), pa.array(name[keep].view(np.int64))], names=["tile", "node"]
        )

    return P.reduce_ranges(members, tidy(work), "tile bigint, node bigint")


def bitmap(value: np.ndarray) -> np.ndarray:
    """Bits of a set's low hash bits; at least four bits per member, a power of two of them."""
    bits = max(64, 1 << int(4 * len(value) - 1).bit_length())
    flags = np.zeros(bits, bool)
    flags[(value & _U(bits - 1)).astype(np.int64)] = True
    return np.packbits(flags, bitorder="little").view(_U)


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """A bitmap (or rows of bitmaps) brought to fewer words; bits that meet are united."""
    while bits.shape[-1] > words:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] | bits[..., half:]
    return bits


def most_overlap(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Upper bound of the overlap from bitmaps of equal width (last axis)."""
    only_a = np.bitwise_count(a & ~b).sum(-1, dtype=np.int64)
    only_b = np.bitwise_count(b & ~a).sum(-1, dtype=np.int64)
    return np.minimum(size_a - only_a, size_b - only_b)


def linked(overlap: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, num: int, den: int) -> np.ndarray:
    return (den * overlap >= num * (size_a + size_b - overlap)) & (overlap > 0)


def _signatures(docs: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """(node, size, bits, hashes) of the nodes (node, doc_id): one row each."""
    joined = docs.join(nodes.withColumnRenamed("doc_id", "rep"), F.col("doc_id").eqNullSafe(F.col("rep"))).select("node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, found in W.word_pieces(batch.column(1), W.spaced(), lower=True):
                value, first = shingle_sets(found, n)
                name = set_id(value, first).view(np.int64)
                wanted = batch.column(0).slice(low, high - low).to_numpy()
                # Rows that share an id may differ in text; only the one meant has the name.
                at = np.flatnonzero(name == wanted)
                sets = [value[first[t] : first[t + 1]] for t in at]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(name[at]),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([bitmap(s).tobytes() for s in sets], pa.binary()),
                        pa.array([s.tobytes() for s in sets], pa.binary()),
                    ],
                    names=["node", "size", "bits", "hashes"],
                )

    found = joined.mapInArrow(tidy(run), "node bigint, size bigint, bits binary, hashes binary")
    return found.dropDuplicates(["node"])


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b, ...) that link: bitmaps first, then exact intersection of what may pass."""
    names = pairs.columns
    schema = ", ".join(f"{c} bigint" for c in names)

    def with_side(frame: DataFrame, side: str, column: str) -> DataFrame:
        other = sets.select(F.col("node").alias(side), F.col("size").alias(f"size_{side}"), F.col(column).alias(f"{column}_{side}"))
        return frame.join(other, side)

    def may_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for sa, ba, sb, bb in zip(*[batch.column(c).to_pylist() for c in ("size_a", "bits_a", "size_b", "bits_b")], strict=True):
                a, b = np.frombuffer(ba, _U), np.frombuffer(bb, _U)
                words = min(len(a), len(b))
                bound = most_overlap(folded(a, words), folded(b, words), sa, sb)
                keep.append(bool(linked(bound, sa, sb, num, den)))
            yield batch.select(names).filter(pa.array(keep, pa.bool_()))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for ha, hb in zip(batch.column("hashes_a").to_pylist(), batch.column("hashes_b").to_pylist(), strict=True):
                a, b = np.frombuffer(ha, _U), np.frombuffer(hb, _U)
                if len(a) > len(b):
                    a, b = b, a
                at = np.minimum(np.searchsorted(b, a), len(b) - 1)
                keep.append(bool(linked(np.int64((b[at] == a).sum()), len(a), len(b), num, den)))
            yield batch.select(names).filter(pa.array(keep, pa.bool_()))

    hopeful = with_side(with_side(pairs, "a", "bits"), "b", "bits").mapInArrow(tidy(may_pass), schema)
    hopeful = stored(hopeful, "ngram-hopeful")
    return with_side(with_side(hopeful, "a", "hashes"), "b", "hashes").mapInArrow(tidy(exact), schema)


def _stars(tiles: DataFrame) -> DataFrame:
    """(a, b): the least member of each tile with each other member, once."""
    heads = tiles.groupBy("tile").agg(F.min("node").alias("a"), F.count("*").alias("m")).where("m > 1")
    heads = stored(heads.select("tile", "a"), "ngram-heads")
    return tiles.join(heads, "tile").where("node <> a").select("a", F.col("node").alias("b")).distinct()


def _open_members(tiles: DataFrame, roots: DataFrame) -> DataFrame:
    """(tile, node, root, m) of the tiles whose m members are not all connected."""
    marked = tiles.join(roots, "node", "left").select("tile", "node", F.coalesce("root", "node").alias("root"))
    marked = stored(marked, "ngram-marked")
    open_ = marked.groupBy("tile").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("m"))
    open_ = stored(open_.where("low <> high").select("tile", "m"), "ngram-open")
    return marked.join(open_, "tile")


def _unsettled(members: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b, root_a, root_b): pairs of different components in one tile whose bitmaps allow a link."""
    parts = F.ceil(F.col("m") / TILE_SETS).cast("int")
    member = members.withColumn("parts", parts)
    member = member.withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    member = member.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    member = member.select(
        F.col("tile").alias("origin"),
        F.xxhash64("tile", F.least("own", "other"), F.greatest("own", "other")).alias("tile"),
        (F.col("own") <= F.col("other")).alias("left"),
        (F.col("own") >= F.col("other")).alias("right"),
        "node",
        "root",
    )
    # A pair that shares several tiles is sent by the least of them only. A set has at most two
    # tiles per segment.
    shared = members.groupBy("node").agg(F.array_sort(F.collect_set("tile")).alias("tiles"))
    member = member.join(sets.select("node", "size", "bits").join(shared, "node"), "node")
    count = P.ranges(members.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        table = pa.Table.from_batches(held)
        tile, node, root, size = (table.column(c).to_numpy() for c in ("tile", "node", "root", "size"))
        left, right = (table.column(c).to_numpy(zero_copy_only=False) for c in ("left", "right"))
        bits = table.column("bits").combine_chunks()
        origin, tiles = table.column("origin").to_numpy(), table.column("tiles").combine_chunks()
        order = np.lexsort((node, tile))
        bounds = np.flatnonzero(np.concatenate([[True], tile[order][1:] != tile[order][:-1], [True]]))
        sent: set[tuple[int, int, int, int]] = set()
        for low, high in zip(bounds[:-1], bounds[1:], strict=True):
            group = order[low:high]
            maps = [np.frombuffer(bits[int(i)].as_py(), _U) for i in group]
            words = min(map(len, maps))
            maps = np.stack([folded(m, words) for m in maps])
            sizes, nodes, roots_ = size[group], node[group], root[group]
            lists = [tiles[int(i)].values.to_numpy() for i in group]
            here = origin[group[0]]
            ones, twos = np.flatnonzero(left[group]), right[group]
            for i in ones:
                # In a block compared with itself every pair is met once: the second behind the first.
                apart = twos & (roots_ != roots_[i]) & ((nodes > nodes[i]) | ~left[group])
                apart &= (sizes * den >= sizes[i] * num) & (sizes[i] * den >= sizes * num)
                js = np.flatnonzero(apart)
                if not len(js):
                    continue
                bound = most_overlap(maps[i], maps[js], sizes[i], sizes[js])
                for j in js[linked(bound, sizes[i], sizes[js], num, den)]:
                    if np.intersect1d(lists[i], lists[j], assume_unique=True)[0] != here:
                        continue
                    one, two = (int(nodes[i]), int(roots_[i])), (int(nodes[j]), int(roots_[j]))
                    one, two = min(one, two), max(one, two)
                    sent.add((one[0], two[0], one[1], two[1]))
            if len(sent) > 100_000:
                yield _pairs(sent)
                sent.clear()
        yield _pairs(sent)

    return member.repartition(count, "tile").mapInArrow(tidy(run), "a bigint, b bigint, root_a bigint, root_b bigint").distinct()


def _pairs(found: set[tuple[int, int, int, int]]) -> pa.RecordBatch:
    rows = sorted(found)
    names = ["a", "b", "root_a", "root_b"]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], names=names)


def _named(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, n_shingles, node) of every row; node is null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, found in W.word_pieces(batch.column(1), W.spaced(), lower=True):
                value, first = shingle_sets(found, n)
                name = set_id(value, first).view(np.int64)
                sizes = np.diff(first)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, high - low), pa.array(sizes), pa.array(name, mask=sizes == 0)],
                    names=["doc_id", "n_shingles", "node"],
                )

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id bigint, n_shingles bigint, node bigint")


def classes(
    docs: DataFrame, n: int = 3, num: int = 90, den: int = 100, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """(``key``, n_shingles, component_id) of every row: its set's size and its class.

    ``component_id`` is the least key reachable by links, the row's own included; a row
    without words has an empty set, links with nothing and has its own key. Null keys are
    least of nothing: a class has one only if all its keys are null. Rows that share a key
    or repeat are rows of their own; equal sets link whatever their keys. Keys must be
    integers. Other columns are not read; an empty table gives no rows. Two different sets
    share a name with probability 2 ** -64 per pair.
    """
    spark = ready(docs.sparkSession)
    docs = docs.select(F.col(f"`{key}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    bands = Bands(num, den)
    named = stored(_named(docs, n), "ngram-sets")
    least = stored(named.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id")), "ngram-nodes")
    tiles = stored(_needed_tiles(_shared_tiles(_entries(docs, n, bands))), "ngram-tiles")
    # Tiles left with one member after the skipping say nothing.
    shared = tiles.groupBy("tile").count().where("count > 1").select("tile")
    tiles = stored(tiles.join(shared, "tile"), "ngram-shared")
    nodes = tiles.select("node").distinct().join(least, "node")
    sets = stored(_signatures(docs, nodes, n), "ngram-signatures")
    stars = stored(_stars(tiles), "ngram-stars")
    links = stored(_verified(stars, sets, num, den), "ngram-links")
    tried = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    # Components that meet in a tile are first bridged by one member each, so that dense groups
    # are one component before their members are compared.
    members = _open_members(tiles, components(links))
    some = stored(members.groupBy("tile", "root").agg(F.max("node").alias("node")).select("tile", "node"), "ngram-some")
    bridges = _stars(some).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    bridges = stored(bridges.join(tried, ["a", "b"], "left_anti"), "ngram-bridges")
    links = stored(links.union(_verified(bridges, sets, num, den)), "ngram-links")
    more = _unsettled(_open_members(tiles, components(links)), sets, num, den)
    more = stored(more.join(tried.union(bridges), ["a", "b"], "left_anti"), "ngram-more")
    # Of all links between two components one is enough.
    joined = _verified(more, sets, num, den).select(F.col("root_a").alias("a"), F.col("root_b").alias("b")).distinct()
    links = links.union(joined)
    roots = components(links)
    member = least.join(roots, "node", "left").select("node", "doc_id", F.coalesce("root", "node").alias("root"))
    member = stored(member, "ngram-members")
    firsts = stored(member.groupBy("root").agg(F.min("doc_id").alias("component_id")), "ngram-firsts")
    member = stored(member.join(firsts, "root").select("node", "component_id"), "ngram-classes")
    out = named.join(member, "node", "left").select(
        F.col("doc_id").alias(key),
        "n_shingles",
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )
    return out
