"""Benchmark decontamination by suffix arrays over the training texts.

The training texts are divided into shards of a few MB. Each shard becomes a suffix array
over its words (ranks by packed leading words, ties refined by doubling until the longest
test item is covered), and every suffix of every test item is found in it by binary
search, one word deeper at a time. The depth at which a suffix's interval runs empty is
its longest verbatim match; the interval's entries are its places. A shard never needs
another shard, so no training text is shuffled.

Test items are handed to the workers in blocks of bounded size; items beyond one block
cost another pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlane.llm import words as W
from ledgerlane.llm.jobs import ready, stored

WINDOW = 10
#: Bytes of test texts per block, on average; what is broadcast at once.
BLOCK_BYTES = 8 << 20


@dataclass
class Items:
    """Words of test items: hashes one after the other, ``first[i] : first[i + 1]`` those of item i."""

    ids: list[int | None]
    hashes: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, ids: list[int | None], texts: list[str | None]) -> Items:
        parts = [np.zeros(0, np.uint64)]
        counts = [np.zeros(0, np.int64)]
        for _, _, found in W.word_pieces(pa.array(texts, pa.string()), W.alphanumeric(), lower=True):
            parts.append(found.hashes())
            counts.append(found.counts)
        first = np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int64)
        return cls(ids, np.concatenate(parts), first)

    @property
    def longest(self) -> int:
        return int(np.diff(self.first).max(initial=0))

    def window(self, size: int) -> np.ndarray:
        """Per word: length of the window that starts there, 0 if none does."""
        lengths = np.diff(self.first)
        wanted = np.repeat(np.minimum(lengths, size), lengths)
        left = np.repeat(self.first[1:], lengths) - np.arange(len(self.hashes))
        return np.where(left >= wanted, wanted, 0)


class SuffixArray:
    """Suffixes of a shard's words in order of their first ``depth`` words; texts end suffixes."""

    def __init__(self, hashes: np.ndarray, first: np.ndarray, depth: int) -> None:
        self.words, code = np.unique(hashes, return_inverse=True)
        n = len(hashes)
        self.n = n
        text = np.repeat(np.arange(len(first) - 1), np.diff(first))
        self.end = first[1:][text]
        self.code = code.astype(np.int64) + 1
        bits = int(len(self.words) + 1).bit_length()
        packed = min(max(1, 63 // bits), max(depth, 1))
        key = np.zeros(n, np.int64)
        for j in range(packed):
            key = key << bits | self.at(np.arange(n), j)
        order = np.argsort(key, kind="stable")
        group = np.concatenate([[True], key[order][1:] != key[order][:-1]]) if n else np.zeros(0, bool)
        # A suffix's rank is the place of the first suffix equal to it so far.
        rank = np.empty(n, np.int64)
        start = np.maximum.accumulate(np.where(group, np.arange(n), 0))
        rank[order] = start
        while packed < depth:
            tied = ~group | np.append(~group[1:], False)
            place = np.flatnonzero(tied)
            if not len(place):
                break
            suffix = order[place]
            after = suffix + packed
            follow = np.where(after < self.end[suffix], rank[np.minimum(after, n - 1)] + 1, 0)
            own = rank[suffix]
            by = np.lexsort((follow, own))
            order[place] = suffix[by]
            own, follow = own[by], follow[by]
            group[place] = np.concatenate([[True], (own[1:] != own[:-1]) | (follow[1:] != follow[:-1])])
            start = np.maximum.accumulate(np.where(group, np.arange(n), 0))
            rank[order[place]] = start[place]
            packed *= 2
        self.order = order

    def at(self, suffix: np.ndarray, depth: int | np.ndarray) -> np.ndarray:
        """Code of the word ``depth`` words into a suffix; 0 behind its text."""
        place = suffix + depth
        return np.where(place < self.end[suffix], self.code[np.minimum(place, self.n - 1)], 0)

    def _bound(self, low: np.ndarray, high: np.ndarray, depth: int, code: np.ndarray, right: bool) -> np.ndarray:
        low, high = low.copy(), high.copy()
        open_ = np.flatnonzero(low < high)
        while len(open_):
            middle = (low[open_] + high[open_]) // 2
            value = self.at(self.order[middle], depth)
            below = value <= code[open_] if right else value < code[open_]
            low[open_] = np.where(below, middle + 1, low[open_])
            high[open_] = np.where(below, high[open_], middle)
            open_ = open_[low[open_] < high[open_]]
        return low

    def search(self, items: Items, window: np.ndarray) -> tuple[np.ndarray, ...]:
        """For every test suffix: (places interval of its window: low, high; longest match; its low, high)."""
        q = len(items.hashes)
        at = np.minimum(np.searchsorted(self.words, items.hashes), max(len(self.words) - 1, 0))
        code = np.where(self.words[at] == items.hashes, at + 1, -1) if len(self.words) else np.full(q, -1)
        item_end = np.repeat(items.first[1:], np.diff(items.first))
        low, high = np.zeros(q, np.int64), np.full(q, self.n)
        wlow, whigh = np.zeros(q, np.int64), np.zeros(q, np.int64)
        length, llow, lhigh = np.zeros(q, np.int64), np.zeros(q, np.int64), np.zeros(q, np.int64)
        live = np.arange(q)
        depth = 0
        while len(live):
            live = live[(live + depth < item_end[live])]
            wanted = code[live + depth]
            live, wanted = live[wanted >= 0], wanted[wanted >= 0]
            if not len(live):
                break
            left = self._bound(low[live], high[live], depth, wanted, right=False)
            right = self._bound(left, high[live], depth, wanted, right=True)
            some = left < right
            live, left, right = live[some], left[some], right[some]
            low[live], high[live] = left, right
            depth += 1
            length[live], llow[live], lhigh[live] = depth, left, right
            full = live[window[live] == depth]
            wlow[full], whigh[full] = low[full], high[full]
        return wlow, whigh, length, llow, lhigh


def _spread(order: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query number, place) of every entry of every interval."""
    count = high - low
    query = np.repeat(np.arange(len(low)), count)
    offset = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    return query, order[np.repeat(low, count) + offset]


def search_shard(found: W.Words, items: Items, size: int) -> list[dict]:
    """Per text of the shard: hit spans in words, items with occurring windows, longest match."""
    n_texts = len(found.first) - 1
    out = [{"spans": [], "items": [], "longest": None} for _ in range(n_texts)]
    hashes = found.hashes()
    # Without a single shared word there is nothing to search.
    if not len(hashes) or not len(items.hashes):
        return out
    array = SuffixArray(hashes, found.first, items.longest)
    window = items.window(size)
    wlow, whigh, length, llow, lhigh = array.search(items, window)
    owner = np.repeat(np.arange(len(items.ids)), np.diff(items.first))
    query, place = _spread(array.order, wlow, whigh)
    if not len(place):
        return out
    n = len(hashes)
    opened = np.bincount(place, minlength=n + 1)
    closed = np.bincount(place + window[query], minlength=n + 1)
    depth = np.cumsum(opened - closed)[:n] > 0
    text = np.searchsorted(found.first, np.arange(n), "right") - 1
    new = depth & np.concatenate([[True], ~depth[:-1] | (text[1:] != text[:-1])])
    last = depth & np.concatenate([~depth[1:] | (text[1:] != text[:-1]), [True]])
    for a, b in zip(np.flatnonzero(new), np.flatnonzero(last), strict=True):
        t = text[a]
        out[t]["spans"].append((int(a - found.first[t]), int(b + 1 - found.first[t])))
    pairs = np.unique(np.stack([text[place], owner[query]], axis=1), axis=0)
    for t, i in pairs:
        if items.ids[i] is not None:
            out[t]["items"].append(items.ids[i])
    # The longest match of each hit text, by length, then item, then place.
    good = np.flatnonzero((window > 0) & (length >= window))
    query, place = _spread(array.order, llow[good], lhigh[good])
    query = good[query]
    by = np.lexsort((place, query, -length[query], text[place]))
    query, place = query[by], place[by]
    firsts = np.flatnonzero(np.concatenate([[True], text[place][1:] != text[place][:-1]]))
    for k in firsts:
        t, i = text[place[k]], owner[query[k]]
        out[t]["longest"] = {
            "item_id": items.ids[i],
            "item_word": int(query[k] - items.first[i]),
            "word": int(place[k] - found.first[t]),
            "length": int(length[query[k]]),
        }
    return out


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])


def _match(numbers: bool) -> tuple[pa.DataType, str]:
    """The type of ``benchmark_match``, in Arrow and as text; ids are numbers or texts."""
    kind, name = (pa.int64(), "bigint") if numbers else (pa.string(), "string")
    longest = pa.struct([("item_id", kind), ("item_word", pa.int64()), ("word", pa.int64()), ("length", pa.int64())])
    parts = [("n_words", pa.int64()), ("spans", pa.list_(_SPAN)), ("items", pa.list_(kind)), ("longest", longest)]
    ddl = (
        f"struct<n_words:bigint,spans:array<struct<start:bigint,end:bigint>>,items:array<{name}>,"
        f"longest:struct<item_id:{name},item_word:bigint,word:bigint,length:bigint>>"
    )
    return pa.struct(parts), ddl


def _numbers(benchmark: DataFrame, key: str) -> bool:
    return benchmark.schema[key].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint")


def blocks(benchmark: DataFrame, key: str, text: str, block_bytes: int) -> Iterator[tuple[list, list]]:
    """(ids, texts) of the distinct test items, in blocks of about ``block_bytes``; the driver holds one at a time."""
    kind = "long" if _numbers(benchmark, key) else "string"
    items = benchmark.select(F.col(f"`{key}`").cast(kind).alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    items = items.where(F.octet_length("text") > 0).distinct()
    total = items.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    count = -(-total // block_bytes)
    for b in range(count):
        rows = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(count)) == b).collect()
        rows.sort(key=lambda r: (r["id"] is not None, *([] if r["id"] is None else [r["id"]]), r["text"]))
        yield [r["id"] for r in rows], [r["text"] for r in rows]


def search(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    keep_text: bool = True,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``docs`` with a column ``benchmark_match``: struct of n_words, spans, items, longest.

    Item ids may be whole numbers or, of any other type, are taken as texts.
    ``spans`` are the hit words (start, end exclusive), in order and apart; ``items`` the
    ids with occurring windows; ``longest`` the longest verbatim match (item_id, its word,
    the document's word, length in words) or null. A window is ``window`` consecutive item
    words; a shorter item with words is one window. Null and empty texts have no words;
    items without id mark words but are not listed, repeated items count once; without
    items no word is hit; repeated rows are searched alike. All columns pass through, but
    ``text`` unless ``keep_text``; one named benchmark_match is replaced.
    """
    spark = ready(docs.sparkSession)
    docs = docs.drop("benchmark_match")
    names = docs.columns
    place = names.index(text)
    fields = {f.name: f.dataType.simpleString() for f in docs.schema}
    out = docs
    given = False
    match, ddl = _match(_numbers(benchmark, item_key))

    def step(frame: DataFrame, handed, carried: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = handed.value
            for batch in batches:
                for low, high, found in W.word_pieces(batch.column(place).cast(pa.string()), W.alphanumeric(), lower=True):
                    rows = search_shard(found, items, window)
                    before = batch.column(len(names)).slice(low, high - low).to_pylist() if carried else [None] * (high - low)
                    matches = []
                    for row, n, old in zip(rows, found.counts.tolist(), before, strict=True):
                        spans, ids, longest = row["spans"], row["items"], row["longest"]
                        if old:
                            spans = spans + [(s["start"], s["end"]) for s in old["spans"]]
                            ids = ids + old["items"]
                            longest = max([x for x in (old["longest"], longest) if x], key=lambda x: x["length"], default=None)
                        matches.append(
                            {
                                "n_words": n,
                                "spans": [{"start": a, "end": b} for a, b in _merge(spans)],
                                "items": sorted(set(ids)),
                                "longest": longest,
                            }
                        )
                    columns = [batch.column(i).slice(low, high - low) for i in range(len(names))]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(matches, match)], names=[*names, "benchmark_match"])

        schema = ", ".join([*[f"`{n}` {t}" for n, t in fields.items()], f"benchmark_match {ddl}"])
        return frame.mapInArrow(run, schema)

    for ids, texts in blocks(benchmark, item_key, item_text, block_bytes):
        if given:
            # Written between passes, so that a task runs one search at a time.
            out = stored(out, "suffix-matches")
        out = step(out, spark.sparkContext.broadcast(Items.of(ids, texts)), given)
        given = True
    if not given:
        out = step(out, spark.sparkContext.broadcast(Items.of([], [])), False)
    return out if keep_text else out.drop(text)


def n_hit() -> Column:
    """Hit words of a row of ``search``."""
    return F.aggregate(
        "benchmark_match.spans", F.lit(0).cast("bigint"), lambda a, s: a + s["end"] - s["start"]
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` without any hit word, with their columns."""
    return search(docs, benchmark, **options).where(F.size("benchmark_match.spans") == 0).select(*docs.columns)


def digest(found: DataFrame) -> DataFrame:
    items = F.array_sort(F.transform("benchmark_match.items", lambda x: x.cast("string")))
    return found.select(
        "doc_id",
        F.col("benchmark_match.n_words").alias("n_words"),
        n_hit().alias("n_hit"),
        F.size(items).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("benchmark_match.spans") > 0).alias("contaminated"),
    )
