"""Language-model scores from a log-frequency Bloom filter.

The filter holds every n-gram with its count c quantised to q = 1 + floor(log2 c): it is
entered q times, as (n-gram, 1) ... (n-gram, q). A count is read back, as the least of its
level, 2 ** (q - 1), by probing level after level until one is missing, so a frequent n-gram
costs more probes and a singleton one entry. False positives can only raise a count.

A filter of the whole corpus grows with it and must not be sent whole to every worker. So it is
made and kept in parts, one per range of n-gram hashes, and the questions go to the parts:

1. Texts are packed into chunks of about CHUNK_BYTES, written once.
2. Every chunk sends its distinct unigrams and bigrams, with their counts in its training texts,
   packed by range. Frequent n-grams are one entry per chunk. N-grams of held-out texts are
   sent with a count of 0.
3. A range's reducer adds the counts up, builds its part of the filter, and probes it for every
   n-gram of every chunk: one byte per distinct n-gram goes back, and the exact count of a word.
4. Each chunk meets its answers, lays them beside its tokens and sums up per document.

So texts are read as often, and as many tables written, whatever the size of the corpus.

p(w | v) = BACK * p(w) + (1 - BACK) * c(v w) / c(v), where p(w) = (c(w) + 1) / (N + V + 1). The counts of
n-grams come from the filter; N, V and c(v), what they are divided by, are exact. As a count read back
is never above the true one, the probabilities of all words after a context add up to at most 1
(false positives aside); what quantising takes off, less than half, is left unassigned. The first
word follows the end token.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlane.llm import packed as P
from ledgerlane.llm import words as W
from ledgerlane.llm.jobs import ready, stored

_U = np.uint64
#: Hash that stands for the end of a text.
END = _U(0xE2D0F7E47A1B5C31)
#: Bytes of text in a chunk, about (more only for a single longer text).
CHUNK_BYTES = 4 << 20
#: Bits and probes per filter entry: about 1 % false positives.
BITS, PROBES = 10, 4
#: Weight of the unigram model.
BACK = 0.3

HELD_OUT_OF, HELD_OUT = 7, 2


def held_out(key: object) -> bool:
    """Whether a document is left out of training: crc32 of its id as text, modulo 7, is 2."""
    return zlib.crc32(("" if key is None else str(key)).encode()) % HELD_OUT_OF == HELD_OUT


def tokens(found: W.Words) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, an end token behind each text's words, and where texts start."""
    texts = len(found.first) - 1
    first = found.first + np.arange(texts + 1)
    out = np.empty(int(first[-1]), _U)
    ends = first[1:] - 1
    inside = np.ones(len(out), bool)
    inside[ends] = False
    out[inside] = found.hashes()
    out[ends] = END
    return out, first


def bigrams(token: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Hash of each token with the one before it; a text's first token follows the end token."""
    before = np.empty_like(token)
    before[1:] = token[:-1]
    if len(token):
        before[first[:-1]] = END
    return W.mix(before * _U(0x8CB92BA72F3D8DD7) + token)


def _added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with summed counts."""
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    at = np.flatnonzero(new)
    return keys[at], np.add.reduceat(counts, at) if len(at) else counts


def planes(values: np.ndarray) -> bytes:
    """Values byte by byte, all first bytes first: sorted keys and small counts compress well so."""
    return values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def unplaned(data: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(data, np.uint8).reshape(size, -1).T.copy().view(kind).ravel()


def chunks(docs: DataFrame) -> DataFrame:
    """(chunk, keys, texts): rows packed in the order in which tasks read them, written once."""
    kind = docs.schema["key"].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        size = 0

        def out() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            ends = pa.array([0, table.num_rows], pa.int32())
            keys, texts = (pa.ListArray.from_arrays(ends, table.column(i).chunk(0)) for i in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array([number]), keys, texts], names=["chunk", "keys", "texts"])

        for batch in batches:
            for low, high, data, _ in W.pieces(batch.column(1), CHUNK_BYTES):
                if held and size + len(data) > CHUNK_BYTES:
                    yield out()
                    number, held, size = number + 1, [], 0
                held.append(batch.slice(low, high - low))
                size += len(data)
        if held:
            yield out()

    return stored(docs.mapInArrow(pack, f"chunk bigint, keys array<{kind}>, texts array<string>"), "lm-chunks")


class Chunk:
    """Tokens and bigrams of a chunk's texts, piece by piece, and the distinct ones, sorted."""

    def __init__(self, texts: pa.Array) -> None:
        self.first, tokens_of, pairs_of = [np.zeros(1, np.int64)], [np.zeros(0, _U)], [np.zeros(0, _U)]
        for _, _, found in W.word_pieces(texts, W.spaced(), lower=True):
            token, first = tokens(found)
            tokens_of.append(token)
            pairs_of.append(bigrams(token, first))
            self.first.append(first[1:] + self.first[-1][-1])
        self.first = np.concatenate(self.first)
        self.token, self.pair = np.concatenate(tokens_of), np.concatenate(pairs_of)

    def counted(self, learn: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Distinct tokens and bigrams, each with its count in the texts to learn from."""
        weight = np.repeat(learn.astype(np.int64), np.diff(self.first))
        return [_added(x, weight) for x in (self.token, self.pair)]


def _counted(packed: DataFrame) -> DataFrame:
    """Packed counts per chunk: (range, chunk, word, word_n, pair, pair_n)."""
    count = P.ranges(packed.sparkSession)
    names = ["range", "chunk", "word", "word_n", "pair", "pair_n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                chunk = Chunk(batch.column(2)[i].values)
                learn = np.array([not held_out(k) for k in batch.column(1)[i].values.to_pylist()], bool)
                name = np.int64(batch.column(0)[i].as_py()).tobytes()
                rows: dict[int, list[bytes]] = {}
                for j, (keys, n) in enumerate(chunk.counted(learn)):
                    for r, at in P.cut(keys, count):
                        row = rows.setdefault(r, [b""] * 4)
                        row[2 * j], row[2 * j + 1] = planes(keys[at]), planes(n[at].astype(np.uint32))
                yield P.row_batch([(r, name, *row) for r, row in rows.items()], names)

    return packed.mapInArrow(run, P.schema(names))


def levels(counts: np.ndarray) -> np.ndarray:
    """floor(log2(count)) of positive counts."""
    return np.frexp(counts.astype(np.float64))[1] - 1


def least_count(quantised: np.ndarray) -> np.ndarray:
    """The least count of each quantised count, which is 1 + its level; 0 where nothing was found."""
    return np.where(quantised > 0, np.exp2(quantised - 1.0), 0.0)


def _places(keys: np.ndarray, level: np.ndarray, bits: np.ndarray, probe: int) -> np.ndarray:
    """Bit number of a probe for (key, level) in a filter of ``bits`` bits."""
    a = W.mix(keys + level.astype(_U) * _U(0x9FB21C651E98DF25))
    b = (a >> _U(17)) | _U(1)
    return (a + _U(probe) * W.mix(b)) % bits


def build_filter(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Bytes of a filter holding the keys' quantised counts."""
    q = 1 + levels(counts)
    size = max(64, int(q.sum()) * BITS)
    flags = np.zeros(-(-size // 8) * 8, bool)
    m = _U(len(flags))
    for level in range(1, int(q.max(initial=0)) + 1):
        own = keys[q >= level]
        for probe in range(PROBES):
            flags[_places(own, np.full(len(own), level), m, probe).astype(np.int64)] = True
    return np.packbits(flags, bitorder="little")


class Filter:
    """Parts of the filter side by side, with the ranges they serve."""

    def __init__(self, parts: list[tuple[int, bytes]], ranges: int) -> None:
        self.ranges = ranges
        self.start = np.full(ranges, -1, np.int64)
        self.bits = np.ones(ranges, _U)
        at = 0
        for r, data in parts:
            self.start[r], self.bits[r] = at, len(data) * 8
            at += len(data)
        self.data = np.frombuffer(b"".join(d for _, d in parts), np.uint8)

    def level(self, keys: np.ndarray) -> np.ndarray:
        """floor(log2(count)) of each key; 0 for keys that are not here."""
        return np.maximum(self.quantised(keys), 1) - 1

    def quantised(self, keys: np.ndarray) -> np.ndarray:
        """Quantised count found of each key; 0 for unseen keys and those of ranges that are not here."""
        where = P.range_of(keys, self.ranges)
        out = np.zeros(len(keys), np.uint8)
        todo = np.flatnonzero(self.start[where] >= 0)
        level = 0
        while len(todo):
            level += 1
            for probe in range(PROBES):
                r = where[todo]
                bit = _places(keys[todo], np.full(len(todo), level), self.bits[r], probe)
                byte = self.data[self.start[r] + (bit >> _U(3)).astype(np.int64)]
                todo = todo[(byte >> (bit & _U(7)).astype(np.uint8)) & 1 == 1]
                if not len(todo):
                    break
            out[todo] = level
        return out


_ANSWERS = pa.schema(
    [("range", pa.int32()), ("chunk", pa.int64()), *[(c, pa.binary()) for c in ("count", "word_q", "pair_q", "bits")], ("distinct", pa.int64()), ("total", pa.int64())]
)


def _answered(columns: dict[str, list[bytes]], r: int) -> Iterator[pa.RecordBatch]:
    """A range's part of the filter, its sums, and what it answers to every chunk."""
    words, pairs = ([unplaned(x, _U) for x in columns[c]] for c in ("word", "pair"))
    word, word_n = _added(np.concatenate(words), np.concatenate([unplaned(x, np.uint32) for x in columns["word_n"]]).astype(np.int64))
    pair, pair_n = _added(np.concatenate(pairs), np.concatenate([unplaned(x, np.uint32) for x in columns["pair_n"]]).astype(np.int64))
    learnt = [(k[n > 0], n[n > 0]) for k, n in ((word, word_n), (pair, pair_n))]
    bits = build_filter(*(np.concatenate(x) for x in zip(*learnt, strict=True))).tobytes()
    part = Filter([(0, bits)], 1)
    rows = [{"range": r, "bits": bits, "distinct": len(learnt[0][0]), "total": int(learnt[0][1].sum())}]
    for name, w, p in zip(columns["chunk"], words, pairs, strict=True):
        exact = word_n[np.searchsorted(word, w)] if len(w) else np.zeros(0, np.int64)
        answer = {"count": planes(exact), "word_q": part.quantised(w).tobytes(), "pair_q": part.quantised(p).tobytes()}
        rows.append({"range": r, "chunk": int(np.frombuffer(name, np.int64)[0]), **answer})
    yield pa.RecordBatch.from_pylist(rows, schema=_ANSWERS)


class Model:
    """What is learnt: the parts of the filter in the shared folder, beside the answers, and their sums."""

    def __init__(self, packed: DataFrame) -> None:
        ddl = "range int, chunk bigint, count binary, word_q binary, pair_q binary, bits binary, distinct bigint, total bigint"
        self.table = stored(P.reduce_ranges(_counted(packed), _answered, ddl), "lm-answers")
        sums = self.table.where("chunk is null").agg(F.sum("distinct").alias("v"), F.sum("total").alias("n")).first()
        self.distinct, self.total = sums["v"] or 0, sums["n"] or 0

    def answers(self) -> DataFrame:
        """(chunk, answers): per chunk what each range answered, by range; as much as the chunk's distinct n-grams."""
        each = F.struct("range", "count", "word_q", "pair_q")
        return self.table.where("chunk is not null").groupBy("chunk").agg(F.array_sort(F.collect_list(each)).alias("answers"))


def probabilities(word: np.ndarray, pair: np.ndarray, context: np.ndarray, everything: int) -> np.ndarray:
    """p(w | v) from the quantised counts of w and of v w, the exact count of v, and N + V + 1."""
    single = (least_count(word) + 1) / everything
    return BACK * single + (1 - BACK) * np.minimum(least_count(pair) / np.maximum(context, 1), 1.0)


def score(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: key, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The model learns from the rows that are not held out and scores all. Null and empty
    texts have one token, the end. Null keys count as an empty id; rows that share a key or
    repeat are rows of their own and all train the model. An empty table gives no rows;
    without training rows all counts are 0. Other columns are not read.
    """
    spark = ready(docs.sparkSession)
    source = docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    kind = source.schema["key"].dataType.simpleString()
    packed = chunks(source)
    model = Model(packed)
    everything = model.total + model.distinct + 1

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                chunk = Chunk(batch.column(1)[i].values)
                if not len(chunk.token):
                    continue
                keys = batch.column(0)[i].values
                found = batch.column(2)[i].as_py()
                exact = np.concatenate([unplaned(a["count"], np.int64) for a in found])
                word_q, pair_q = (np.frombuffer(b"".join(a[c] for a in found), np.uint8) for c in ("word_q", "pair_q"))
                # Answers come by range, and so in the order of the sorted distinct n-grams.
                at = np.searchsorted(np.unique(chunk.token), chunk.token)
                known, first = exact[at], chunk.first
                context = np.empty(len(known), np.int64)
                context[1:] = known[:-1]
                # A text's first token follows the end token, which is also its last.
                context[first[:-1]] = known[first[1:] - 1]
                pair = pair_q[np.searchsorted(np.unique(chunk.pair), chunk.pair)]
                p = probabilities(word_q[at], pair, context, everything)
                base = np.log10((known + 1) / everything)
                sums = [np.add.reduceat(x, first[:-1]) for x in ((known > 0).astype(np.int64), base, np.log10(p))]
                held = pa.array([held_out(k) for k in keys.to_pylist()], pa.bool_())
                yield pa.RecordBatch.from_arrays(
                    [keys, held, pa.array(np.diff(first)), *[pa.array(x) for x in sums]],
                    names=["key", "held_out", "n_tokens", "n_known", "base", "score"],
                )

    both = packed.join(model.answers(), "chunk").select("keys", "texts", "answers")
    schema = f"key {kind}, held_out boolean, n_tokens bigint, n_known bigint, base double, score double"
    return both.mapInArrow(final, schema).select(
        F.col("key").alias(key),
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(model.total).cast("bigint").alias("train_tokens"),
        F.col("base").alias("base_score"),
        "score",
    )
