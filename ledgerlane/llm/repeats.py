"""Substring deduplication by level-wise doubling.

A window is ``window`` consecutive words of one document. A window that also starts earlier
(smaller key, or same document and earlier start) is removed with all its words; all windows
are judged on the input.

Windows that repeat at one length alone are extended to twice that length, up to the full
one; the first length is a parameter. Below the full length not every word sequence is
looked up: a window is represented by the one with the least hash within it, which two
equal windows have in common. A window stays a candidate only if its representative occurs
at two places or more. So the first level sends one entry per six words or fewer, and the
last one only windows that almost surely repeat.

Entries travel packed (see ``packed``). A task that meets a sequence twice settles its own
places at once and sends one entry for all, so a passage in a third of all documents
arrives as one entry per task. Sequences are compared by 64-bit hashes; at the last level
only those windows meet whose representatives were equal at the other levels too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlane.llm import packed as P
from ledgerlane.llm import words as W
from ledgerlane.llm.jobs import ready, stored

_U = np.uint64
WINDOW = 20
#: Stands for a missing key; missing keys come before all others.
NO_KEY = -(1 << 63)
#: Kinds of entries: to be answered, one for several settled places, already answered.
ASKED, SETTLED, PASSED = 0, 1, 2


def least_positions(value: np.ndarray, width: int) -> np.ndarray:
    """Position of the least of ``width`` values from each position, the leftmost of equals."""
    size = len(value) - width + 1
    if size <= 0:
        return np.zeros(0, np.int64)
    at = np.arange(len(value))
    span = 1
    while span * 2 <= width:
        other = at[span:]
        at = at[: len(other)]
        at = np.where(value[other] < value[at], other, at)
        span *= 2
    left, right = at[:size], at[width - span : width - span + size]
    return np.where(value[right] < value[left], right, left)


class Level:
    """Representatives of length ``length`` of the windows of some texts."""

    def __init__(self, hashes: np.ndarray, first: np.ndarray, window: int, length: int) -> None:
        self.gram = W.grams(hashes, length)
        self.at = least_positions(self.gram, window - length + 1)

    def of(self, low: int, high: int) -> np.ndarray:
        """Hashes of the representatives of the windows low : high."""
        return self.gram[self.at[low:high]]


def _windows(first: np.ndarray, t: int, window: int) -> tuple[int, int]:
    """First window of text t and the one after the last; none if the text is too short."""
    return int(first[t]), max(int(first[t]), int(first[t + 1]) - window + 1)


def _inside(values: np.ndarray, wanted: bytes | None) -> np.ndarray:
    """Which values are among the sorted hashes ``wanted``."""
    table = np.frombuffer(wanted or b"", _U)
    if not len(table):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return table[at] == values


def _keys(column: pa.Array) -> np.ndarray:
    return column.fill_null(NO_KEY).to_numpy(zero_copy_only=False)


_ENTRY = ["range", "hash", "doc", "kind"]


def _asked_rows(value: np.ndarray, doc: np.ndarray, count: int) -> list[tuple]:
    """Packed entries of one task's places: equal hashes are settled here, with one entry for others."""
    order = np.argsort(value, kind="stable")
    value, sorted_doc = value[order], doc[order]
    new = np.ones(len(value), bool)
    new[1:] = value[1:] != value[:-1]
    # Back in the order of the texts, in which document keys shrink well when written.
    at = np.empty(len(order), np.int64)
    at[order] = np.arange(len(order))
    several = (~new | np.append(~new[1:], False))[at]
    value, doc, new = value[at], sorted_doc[at], new[at]
    rows = []
    single = ~several
    head = new & several
    asked = np.concatenate([value[single], value[head]])
    owner = np.concatenate([doc[single], doc[head]])
    kind = np.concatenate([np.full(single.sum(), ASKED, np.uint8), np.full(head.sum(), SETTLED, np.uint8)])
    for r, at in P.cut(asked, count):
        rows.append((r, asked[at].tobytes(), owner[at].tobytes(), kind[at].tobytes()))
    passed, owner = value[several], doc[several]
    # Settled places go straight to where their document is gathered.
    for r, at in P.cut(W.mix(owner.astype(_U)), count):
        rows.append((r, passed[at].tobytes(), owner[at].tobytes(), np.full(len(at), PASSED, np.uint8).tobytes()))
    return rows


def _repeated(entries: DataFrame) -> DataFrame:
    """(doc, hashes): the representatives of each document that occur at two places or more."""
    count = P.ranges(entries.sparkSession)
    names = ["range", "doc", "hash"]

    def find(columns: dict[str, list[bytes]], _: int) -> Iterator[pa.RecordBatch]:
        value, doc, kind = P.joined(columns["hash"], _U), P.joined(columns["doc"], np.int64), P.joined(columns["kind"], np.uint8)
        passed = kind == PASSED
        v, d, k = value[~passed], doc[~passed], kind[~passed]
        order = np.argsort(v, kind="stable")
        v, d, k = v[order], d[order], k[order]
        new = np.ones(len(v), bool)
        new[1:] = v[1:] != v[:-1]
        many = (~new | np.append(~new[1:], False)) & (k == ASKED)
        v, d = np.concatenate([value[passed], v[many]]), np.concatenate([doc[passed], d[many]])
        yield P.row_batch([(r, d[at].tobytes(), v[at].tobytes()) for r, at in P.cut(W.mix(d.astype(_U)), count)], names)

    def gather(columns: dict[str, list[bytes]], _: int) -> Iterator[pa.RecordBatch]:
        doc, value = P.joined(columns["doc"], np.int64), P.joined(columns["hash"], _U)
        order = np.lexsort((value, doc))
        doc, value = doc[order], value[order]
        keep = np.ones(len(doc), bool)
        keep[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
        yield _by_doc(doc[keep], value[keep], "hashes")

    found = P.reduce_ranges(entries, find, P.schema(names))
    return P.reduce_ranges(found, gather, "doc bigint, hashes binary")


def _by_doc(doc: np.ndarray, value: np.ndarray, name: str) -> pa.RecordBatch:
    """A row per document with its values; both sorted by document."""
    new = np.ones(len(doc), bool)
    new[1:] = doc[1:] != doc[:-1]
    bounds = np.append(np.flatnonzero(new), len(doc))
    data, width = value.tobytes(), value.dtype.itemsize
    cells = [data[a * width : b * width] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(doc[new]), pa.array(cells, pa.binary())], names=["doc", name])


def _with(docs: DataFrame, other: DataFrame, column: str) -> DataFrame:
    """``docs`` with a column of ``other``, null where the document has none."""
    other = other.select(F.col("doc").alias("other_doc"), F.col(other.columns[1]).alias(column))
    return docs.join(other, F.col("doc") == F.col("other_doc"), "left").drop("other_doc")


def _kept_words(raw: bytes, remove: np.ndarray | None) -> bytes:
    parts = raw.split()  # bytes split at exactly \\x20 and \\x09-\\x0D
    if remove is not None:
        parts = [p for p, gone in zip(parts, remove.tolist(), strict=True) if not gone]
    return b" ".join(parts)


def lengths(window: int, first: int) -> list[int]:
    """Lengths below the window's, each twice the one before; the last is at least half of it."""
    out = [first]
    while out[-1] * 2 < window:
        out.append(out[-1] * 2)
    return out


def remove_repeats(
    docs: DataFrame,
    window: int = WINDOW,
    text: str = "text",
    key: str = "doc_id",
    kept: str = "text",
    first_length: int | None = None,
) -> DataFrame:
    """One row per row of ``docs``: key, n_words, n_removed and what is kept.

    ``kept`` is "text" (column kept_text: the kept words joined by one space) or "sha256"
    (column kept_sha256: lower-case hex of that text's digest; less is written).
    ``first_length`` is the length of the first level, half the window if not given; a
    shorter one adds levels and changes no result. Null and empty texts have no words and
    keep an empty text. Keys must be integers; rows without key come before all others and
    count as one document. Rows that share a key are one document in the order rule: a
    window is removed if an equal one starts at a smaller word number in any of them, or in
    a document with a smaller key, so repeated rows do not remove each other. An empty
    table gives no rows; other columns are not read.
    """
    first_length = window // 2 if first_length is None else first_length
    if not 1 <= first_length < window:
        raise ValueError("the first length must be shorter than the window")
    spark = ready(docs.sparkSession)
    count = P.ranges(spark)
    out_name = "kept_text" if kept == "text" else "kept_sha256"
    levels = lengths(window, first_length)
    pending = docs.select(
        F.coalesce(F.col(f"`{key}`").cast("bigint"), F.lit(NO_KEY)).alias("doc"), F.col(f"`{text}`").cast("string").alias("text")
    )

    def finish(raw: bytes, remove: np.ndarray | None) -> str:
        words = _kept_words(raw, remove)
        return words.decode("utf-8") if kept == "text" else hashlib.sha256(words).hexdigest()

    def candidates(found: W.Words, hashes: np.ndarray, rows: list[list[bytes | None]]) -> list[np.ndarray]:
        """Per text its windows whose representatives repeat at all levels passed so far."""
        passed = [Level(hashes, found.first, window, n) for n in levels[: len(rows)]]
        out = []
        for t, n in enumerate(found.counts):
            a, b = _windows(found.first, t, window)
            good = np.full(b - a, n >= window)
            for level, wanted in zip(passed, rows, strict=True):
                good &= _inside(level.of(a, b), wanted[t])
            out.append(a + np.flatnonzero(good))
        return out

    def asking(step: int):
        """Entries of the representatives at a level, of the windows left by the levels before."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for low, high, found in W.word_pieces(batch.column(1), W.spaced(), lower=False):
                    doc = _keys(batch.column(0).slice(low, high - low))
                    rows = [batch.column(2 + i).slice(low, high - low).to_pylist() for i in range(step)]
                    hashes = found.hashes()
                    level = Level(hashes, found.first, window, levels[step])
                    places = np.unique(level.at[np.concatenate(candidates(found, hashes, rows))])
                    owner = doc[np.searchsorted(found.first, places, "right") - 1]
                    yield P.row_batch(_asked_rows(level.gram[places], owner, count), _ENTRY)

        return run

    def settling(step: int):
        """Rows without candidates are done; the others go on with their text."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for low, high, found in W.word_pieces(batch.column(1), W.spaced(), lower=False):
                    rows = [batch.column(2 + i).slice(low, high - low).to_pylist() for i in range(step + 1)]
                    some = any(w is not None for w in rows[-1])
                    at = candidates(found, found.hashes(), rows) if some else []
                    raw, bounds = found.data.tobytes(), found.text_start.tolist()
                    texts, done = [], []
                    for t in range(high - low):
                        own = raw[bounds[t] : bounds[t + 1]]
                        going = some and len(at[t]) > 0
                        texts.append(own.decode("utf-8") if going else None)
                        done.append(None if going else finish(own, None))
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).slice(low, high - low),
                            pa.array(found.counts),
                            pa.array(done, pa.string()),
                            pa.array(texts, pa.string()),
                            *[pa.array([w if x is not None else None for w, x in zip(r, texts, strict=True)], pa.binary()) for r in rows],
                        ],
                        names=["doc", "n_words", "kept", "text", *[f"level{i}" for i in range(step + 1)]],
                    )

        return run

    done = []
    for step in range(len(levels)):
        repeated = _repeated(pending.mapInArrow(asking(step), P.schema(_ENTRY)))
        columns = [f"level{i}" for i in range(step + 1)]
        schema = ", ".join(["doc bigint, n_words bigint, kept string, text string", *[f"{c} binary" for c in columns]])
        settled = _with(pending, repeated, columns[-1]).mapInArrow(settling(step), schema)
        settled = stored(settled, "repeats-settled")
        done.append(settled.where("text is null").select("doc", "n_words", F.lit(0).cast("bigint").alias("n_removed"), "kept"))
        pending = settled.where("text is not null").select("doc", "text", *columns)
    names = ["range", "hash", "doc", "start", "tag", "kind"]

    def last_level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, found in W.word_pieces(batch.column(1), W.spaced(), lower=False):
                doc = _keys(batch.column(0).slice(low, high - low))
                rows = [batch.column(2 + i).slice(low, high - low).to_pylist() for i in range(len(levels))]
                hashes = found.hashes()
                places = np.concatenate(candidates(found, hashes, rows))
                text = np.searchsorted(found.first, places, "right") - 1
                value = W.grams(hashes, window)[places]
                start = (places - found.first[text]).astype(np.uint32)
                yield P.row_batch(_starts_rows(value, doc[text], start, _tags(found, text), count), names)

    def firsts(columns: dict[str, list[bytes]], _: int) -> Iterator[pa.RecordBatch]:
        value, doc = P.joined(columns["hash"], _U), P.joined(columns["doc"], np.int64)
        start, tag = P.joined(columns["start"], np.uint32), P.joined(columns["tag"], np.uint32)
        kind = P.joined(columns["kind"], np.uint8)
        later = kind == PASSED
        asked = np.flatnonzero(~later)
        later[asked] = _later(value[asked], doc[asked], start[asked])
        order = np.lexsort((start[later], doc[later]))
        doc, start, tag = doc[later][order], start[later][order], tag[later][order]
        where = P.cut(W.mix(doc.astype(_U)), count)
        yield P.row_batch([(r, doc[i].tobytes(), start[i].tobytes(), tag[i].tobytes()) for r, i in where], ["range", "doc", "start", "tag"])

    def gather(columns: dict[str, list[bytes]], _: int) -> Iterator[pa.RecordBatch]:
        doc = P.joined(columns["doc"], np.int64)
        both = P.joined(columns["tag"], np.uint32).astype(_U) << _U(32) | P.joined(columns["start"], np.uint32).astype(_U)
        order = np.lexsort((both, doc))
        yield _by_doc(doc[order], both[order], "starts")

    asked = pending.mapInArrow(last_level, P.schema(names))
    gone = P.reduce_ranges(asked, firsts, P.schema(["range", "doc", "start", "tag"]))
    gone = P.reduce_ranges(gone, gather, "doc bigint, starts binary")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, found in W.word_pieces(batch.column(1), W.spaced(), lower=False):
                starts = batch.column(2).slice(low, high - low).to_pylist()
                tags = _tags(found, np.arange(high - low))
                raw, bounds = found.data.tobytes(), found.text_start.tolist()
                out, removed = [], []
                for t, n in enumerate(found.counts.tolist()):
                    mark = None
                    if starts[t] is not None:
                        pair = np.frombuffer(starts[t], _U)
                        own = (pair[(pair >> _U(32)).astype(np.uint32) == tags[t]] & _U(0xFFFFFFFF)).astype(np.int64)
                        step = np.bincount(own, minlength=n + 1) - np.bincount(own + window, minlength=n + 1)
                        mark = np.cumsum(step)[:n] > 0
                    removed.append(0 if mark is None else int(mark.sum()))
                    out.append(finish(raw[bounds[t] : bounds[t + 1]], mark))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, high - low), pa.array(found.counts), pa.array(removed, pa.int64()), pa.array(out, pa.string())],
                    names=["doc", "n_words", "n_removed", "kept"],
                )

    final = _with(pending.select("doc", "text"), gone, "starts").mapInArrow(
        remove, "doc bigint, n_words bigint, n_removed bigint, kept string"
    )
    for rows in done:
        final = final.union(rows)
    return final.select(
        F.when(F.col("doc") == NO_KEY, None).otherwise(F.col("doc")).alias(key), "n_words", "n_removed", F.col("kept").alias(out_name)
    )


def _tags(found: W.Words, text: np.ndarray) -> np.ndarray:
    """A 32-bit name of each text's words in their order, to tell rows with one key apart."""
    total = np.zeros(len(found.start) + 1, _U)
    inside = (np.arange(len(found.start)) - np.repeat(found.first[:-1], found.counts)).astype(_U)
    np.cumsum(W.mix(found.hashes() ^ W.mix(inside + _U(1))), out=total[1:])
    sums = total[found.first[1:]] - total[found.first[:-1]]
    return (sums >> _U(32)).astype(np.uint32)[text]


def _later(value: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which places have an equal window at a smaller (document, start)."""
    order = np.lexsort((start, doc, value))
    v, d, s = value[order], doc[order], start[order]
    new = np.ones(len(v), bool)
    new[1:] = v[1:] != v[:-1]
    head = np.maximum.accumulate(np.where(new, np.arange(len(v)), 0)) if len(v) else np.zeros(0, np.int64)
    out = np.empty(len(v), bool)
    out[order] = (d != d[head]) | (s != s[head])
    return out


def _starts_rows(value: np.ndarray, doc: np.ndarray, start: np.ndarray, tag: np.ndarray, count: int) -> list[tuple]:
    """Packed windows: those that are later within the task are settled; the first asks for all others."""
    later = _later(value, doc, start)
    rows = []
    asked = np.flatnonzero(~later)
    for r, at in P.cut(value[asked], count):
        i = asked[at]
        rows.append((r, value[i].tobytes(), doc[i].tobytes(), start[i].tobytes(), tag[i].tobytes(), np.full(len(i), ASKED, np.uint8).tobytes()))
    passed = np.flatnonzero(later)
    for r, at in P.cut(W.mix(doc[passed].astype(_U)), count):
        i = passed[at]
        rows.append((r, value[i].tobytes(), doc[i].tobytes(), start[i].tobytes(), tag[i].tobytes(), np.full(len(i), PASSED, np.uint8).tobytes()))
    return rows
