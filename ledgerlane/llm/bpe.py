"""Word-based BPE encoding and decoding with a minimal acyclic transducer of frequent words.

The tokenizer file (path is a parameter) gives vocabulary, merges and special tokens;
nothing is trained. Work is split in two:

* The most frequent words of all texts, counted exactly over the whole input, are encoded
  once on the driver and compiled into a minimal acyclic automaton: equal suffixes share
  states, and every transition knows how many words sort before the ones it leads to, so
  that walking a word yields its number and with it its ids. The automaton is a few flat
  arrays in one file, which Spark hands to every executor and workers memory-map.
* All other words are merged exactly, lowest rank first, leftmost first.

LEXICON_WORDS bounds the automaton whatever the input; it decides only which way a word
takes, never its ids.
"""

from __future__ import annotations

import heapq
import json
import re
import tempfile
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlane.llm import words as W
from ledgerlane.llm.jobs import ready, stored

#: Words compiled into the automaton, and the longest of them in bytes.
LEXICON_WORDS = 32_768
LEXICON_BYTES = 32
#: Steps per doubling in the histogram of word counts.
STEPS = 8
#: Distinct words a counting task holds before it hands on partial counts.
COUNTED_WORDS = 300_000
#: Distinct words a worker remembers; beyond, it starts anew.
REMEMBERED_WORDS = 300_000

_NONE = np.int32(2**31 - 1)
#: Contractions and word classes of the tokenizer's splitting pattern.
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
#: Characters below this are normalised here; texts with others by the tokenizer's own normaliser.
#: Their small letters lie below LOWER_END.
PLAIN_END, LOWER_END = 0x23A, 0x300


def _ranges(keep) -> str:
    """A character class of the plain characters and their small letters that ``keep`` accepts."""
    return "".join(re.escape(chr(i)) for i in range(LOWER_END) if keep(chr(i)))


@cache
def _plain_pattern() -> re.Pattern:
    letter = _ranges(lambda c: unicodedata.category(c)[0] == "L")
    number = _ranges(lambda c: unicodedata.category(c)[0] == "N")
    space = _ranges(lambda c: c in "\t\n\v\f\r \x85\xa0")
    return re.compile(f"{CONTRACTIONS}|[{letter}]+|[{number}]|[^{space}{letter}{number}]+")


_OTHER = re.compile(f"[^\\x00-{chr(PLAIN_END - 1)}]")


@cache
def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return [chr(b) if b in set(shown) else chr(256 + hidden.index(b)) for b in range(256)]


class Tokenizer:
    """Vocabulary and merges of a tokenizer file, with exact merging of single words."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer as Library

        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        model = spec["model"]
        vocab = model["vocab"]
        suffix = model["end_of_word_suffix"]
        self.library = Library.from_file(path)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.splitter = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.token = [""] * size
        for text, i in [*vocab.items(), *self.special.items()]:
            self.token[i] = text
        self.number = [str(i) for i in range(size)]
        symbols = byte_symbols()
        self.inner = np.array([vocab[c] for c in symbols], np.int32)
        self.final = np.array([vocab[c + suffix] for c in symbols], np.int32)
        self.bytes_of = {c: i for i, c in enumerate(symbols)}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.size = size
        keys = np.array([vocab[a] * size + vocab[b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        # Of a pair listed twice the later rank holds, as in a map filled in order.
        last = np.append(keys[order][1:] != keys[order][:-1], True)
        self.pair = keys[order][last]
        self.rank = order[last].astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int32)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where(self.pair[at] == key, self.rank[at], _NONE)

    def merge_long(self, word: bytes) -> list[int]:
        """One word by a heap of pairs; for words of any length."""
        ids = [int(self.inner[b]) for b in word[:-1]] + [int(self.final[word[-1]])]
        n = len(ids)
        after, before, live = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap: list[tuple[int, int, int, int]] = []

        def push(i: int) -> None:
            j = after[i]
            if i >= 0 and j < n:
                r = int(self.ranks(np.array([ids[i]]), np.array([ids[j]]))[0])
                if r != _NONE:
                    heapq.heappush(heap, (r, i, ids[i], ids[j]))

        first = self.ranks(np.array(ids[:-1], np.int32), np.array(ids[1:], np.int32))
        heap = [(int(r), i, ids[i], ids[i + 1]) for i, r in enumerate(first) if r != _NONE]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not live[i] or j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], live[j], after[i] = int(self.made[r]), False, after[j]
            if after[j] < n:
                before[after[j]] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        return [x for x, keep in zip(ids, live, strict=True) if keep]

    def merge(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each non-empty word; words of one length are merged together."""
        out: list[list[int]] = [[]] * len(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        for size in np.unique(lengths):
            at = np.flatnonzero(lengths == size)
            if size > 64:
                for i in at:
                    out[i] = self.merge_long(words[i])
                continue
            raw = np.frombuffer(b"".join([words[i] for i in at]), np.uint8).reshape(-1, size)
            ids = self.inner[raw]
            ids[:, -1] = self.final[raw[:, -1]]
            for i, row in zip(at, self._merge_block(ids), strict=True):
                out[i] = row
        return out

    def _merge_block(self, ids: np.ndarray) -> list[list[int]]:
        n, size = ids.shape
        count = np.full(n, size)
        todo = np.arange(n)
        columns = np.arange(size)
        rank = np.full((n, size), _NONE, np.int32)
        if size > 1:
            rank[:, :-1] = self.ranks(ids[:, :-1], ids[:, 1:])
        done = np.empty_like(ids)
        while len(todo):
            best = rank.argmin(1)
            rows = np.arange(len(todo))
            least = rank[rows, best]
            more = least != _NONE
            done[todo[~more]] = ids[~more]
            todo, ids, rank, best, least = todo[more], ids[more], rank[more], best[more], least[more]
            if not len(todo):
                break
            rows = np.arange(len(todo))
            ids[rows, best] = self.made[least]
            # Drop the right half of the pair: everything after it moves one to the left.
            take = np.minimum(columns + (columns > best[:, None]), size - 1)
            ids = np.take_along_axis(ids, take, 1)
            rank = np.take_along_axis(rank, take, 1)
            rank[:, -1] = _NONE
            count[todo] -= 1
            left = best > 0
            r, b = rows[left], best[left]
            rank[r, b - 1] = self.ranks(ids[r, b - 1], ids[r, b])
            right = best + 1 < count[todo]
            r, b = rows[right], best[right]
            rank[r, b] = self.ranks(ids[r, b], ids[r, b + 1])
            rank[rows[~right], best[~right]] = _NONE
        return [row[:c].tolist() for row, c in zip(done, count, strict=True)]

    def words(self, text: str) -> list[str]:
        """Words of a text without special tokens, normalised."""
        if _OTHER.search(text) is None:
            return _plain_pattern().findall(text.lower())
        normal = self.library.normalizer.normalize_str(text)
        return [
            bytes(self.bytes_of[c] for c in piece).decode("utf-8")
            for piece, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)
        ]


@cache
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


def compile_lexicon(words: list[bytes], ids: list[list[int]]) -> bytes:
    """The minimal acyclic automaton of distinct words with their ids, as one file.

    Words are added in order; a state that can change no more is replaced by an equal
    one if there is one, which merges common endings.
    """
    order = sorted(range(len(words)), key=words.__getitem__)
    # A state: [final, {byte: child}]; `known` maps its content to a number.
    known: dict[tuple, int] = {}
    table: list[tuple[bool, tuple[tuple[int, int], ...]]] = []

    def settle(state: list) -> int:
        content = (state[0], tuple(sorted(state[1].items())))
        if content not in known:
            known[content] = len(table)
            table.append(content)
        return known[content]

    open_states: list[list] = [[False, {}]]
    last = b""

    def close(depth: int) -> None:
        while len(open_states) > depth + 1:
            number = settle(open_states.pop())
            open_states[-1][1][last[len(open_states) - 1]] = number

    for i in order:
        word = words[i]
        common = 0
        while common < min(len(word), len(last)) and word[common] == last[common]:
            common += 1
        close(common)
        open_states += [[False, {}] for _ in range(len(word) - common)]
        open_states[-1][0] = True
        last = word
    close(0)
    root = settle(open_states[0])
    # Children have lower numbers than their parents, so one pass counts the words of each state.
    reach = [0] * len(table)
    for s, (final, edges) in enumerate(table):
        reach[s] = final + sum(reach[t] for _, t in edges)
    key, target, skip = [], [], []
    for s, (final, edges) in enumerate(table):
        before = int(final)
        for byte, t in edges:
            key.append(s << 8 | byte)
            target.append(t)
            skip.append(before)
            before += reach[t]
    flat = [x for i in order for x in ids[i]]
    starts = np.cumsum([0, *(len(ids[i]) for i in order)])
    parts = [
        np.array(key, np.int64),
        np.array(target, np.int64),
        np.array(skip, np.int64),
        np.array([f for f, _ in table], np.int64),
        starts.astype(np.int64),
        np.array(flat, np.int64),
    ]
    head = np.array([root, *(len(p) for p in parts)], np.int64)
    return b"".join(p.tobytes() for p in (head, *parts))


class Lexicon:
    """A compiled automaton, memory-mapped."""

    def __init__(self, path: str) -> None:
        data = np.memmap(path, np.int64, "r")
        self.root = int(data[0])
        at, parts = 7, []
        for size in data[1:7]:
            parts.append(data[at : at + size])
            at += int(size)
        self.key, self.target, self.skip, self.final, self.start, self.ids = parts

    def find(self, words: list[bytes]) -> np.ndarray:
        """Each word's number, or -1; all words walk the automaton in step."""
        out = np.full(len(words), -1, np.int64)
        if not len(self.key) or not words:
            return out
        size = np.fromiter(map(len, words), np.int64, len(words))
        todo = np.flatnonzero((size <= LEXICON_BYTES) & (size > 0))
        if not len(todo):
            return out
        wide = b"".join([words[i].ljust(LEXICON_BYTES, b"\0") for i in todo])
        letters = np.frombuffer(wide, np.uint8).reshape(-1, LEXICON_BYTES)
        row = np.arange(len(todo))
        state, number = np.full(len(todo), self.root), np.zeros(len(todo), np.int64)
        for depth in range(LEXICON_BYTES + 1):
            ended = size[todo[row]] == depth
            accepted = ended & (self.final[state] == 1)
            out[todo[row[accepted]]] = number[accepted]
            row, state, number = row[~ended], state[~ended], number[~ended]
            if not len(row):
                break
            key = state << 8 | letters[row, depth]
            at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            good = self.key[at] == key
            row, at = row[good], at[good]
            number = number[good] + self.skip[at]
            state = self.target[at]
        return out

    def output(self, number: int) -> list[int]:
        return self.ids[self.start[number] : self.start[number + 1]].tolist()


class Encoder:
    """Encodes texts; remembers the words it has met, up to a bound."""

    def __init__(self, tok: Tokenizer, lexicon: Lexicon) -> None:
        self.tok, self.lexicon = tok, lexicon
        self.known: dict[str, tuple[int, str, str]] = {}
        for text, i in tok.special.items():
            self.known[text] = (1, str(i), text)

    def learn(self, words: set[str]) -> None:
        if len(self.known) + len(words) > REMEMBERED_WORDS:
            self.known = {t: self.known[t] for t in self.tok.special}
        new = [w for w in words if w not in self.known]
        raw = [w.encode("utf-8") for w in new]
        numbers = self.lexicon.find(raw).tolist()
        unseen = [i for i, n in enumerate(numbers) if n < 0]
        merged = dict(zip(unseen, self.tok.merge([raw[i] for i in unseen]), strict=True))
        token, number = self.tok.token, self.tok.number
        for i, n in enumerate(numbers):
            ids = merged[i] if n < 0 else self.lexicon.output(n)
            self.known[new[i]] = (
                len(ids),
                " ".join([number[x] for x in ids]),
                " ".join([token[x] for x in ids]),
            )

    def split(self, text: str) -> list[str]:
        if "<|" not in text and not any(t in text for t in self.tok.special):
            return self.tok.words(text)
        out: list[str] = []
        for part in self.tok.splitter.split(text):
            if part in self.tok.special:
                out.append(part)
            else:
                out += self.tok.words(part)
        return out

    def encode(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """(number of ids, ids in decimal joined by a space, decoded text) of each text."""
        split = [self.split(t) for t in texts]
        words: set[str] = set()
        for s in split:
            words.update(s)
        self.learn(words)
        known = self.known
        out = []
        for s in split:
            found = [known[w] for w in s]
            out.append(
                (sum([x[0] for x in found]), " ".join([x[1] for x in found]), " ".join([x[2] for x in found]))
            )
        return out


def frequent_words(docs: DataFrame, path: str, text: str = "text", limit: int = LEXICON_WORDS) -> list[str]:
    """The most frequent words of up to LEXICON_BYTES bytes, from exact counts of all texts.

    All words with at least a certain count, chosen from a histogram of counts such that they
    are ``limit`` at most; only that histogram and these words reach the driver.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        encoder_split = Encoder(tok, None).split  # only its splitting is used
        seen: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays(
                [pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"]
            )
            seen.clear()
            return batch

        for batch in batches:
            for value in batch.column(0):
                seen.update(encoder_split(value.as_py() or ""))
                if len(seen) > COUNTED_WORDS:
                    yield out()
        yield out()

    counts = (
        docs.select(F.col(f"`{text}`").cast("string").alias("text"))
        .mapInArrow(count, "word string, n bigint")
        .where((F.octet_length("word") <= LEXICON_BYTES) & (F.octet_length("word") > 0))
        .groupBy("word")
        .agg(F.sum("n").alias("n"))
        .withColumn("step", F.floor(F.log2("n") * STEPS).cast("int"))
    )
    counts = stored(counts, "bpe-words")
    steps = sorted(counts.groupBy("step").count().collect(), reverse=True)  # at most 63 * STEPS rows
    least, above = None, 0
    for step, n in steps:
        above += n
        if above > limit:
            break
        least = step
    if least is None:
        return []
    special = set(tokenizer(path).special)
    rows = counts.where(F.col("step") >= least).select("n", "word").collect()  # at most ``limit`` rows
    return [w for _, w in sorted((-n, w) for n, w in rows) if w not in special]


def publish(spark, data: bytes) -> str:
    """Hands a small file to all executors, also later ones; returns its name."""
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    path = Path(tempfile.mkdtemp(prefix="lexicon-")) / name  # the driver's own copy, which Spark serves
    path.write_bytes(data)
    spark.sparkContext.addFile(str(path))
    return name


_FORMS = {"array": "ids array<int>", "text": "ids_text string"}


def encode(
    docs: DataFrame,
    path: str,
    text: str = "text",
    key: str = "doc_id",
    form: str = "array",
    decoded: bool = False,
    lexicon_words: int = LEXICON_WORDS,
) -> DataFrame:
    """One row per row of ``docs``: the key, n_tokens, the ids, and the decoded text if asked.

    ``form`` gives the ids as an array (``ids``) or in decimal joined by one space
    (``ids_text``). Null and empty texts have no ids and decode to an empty text; repeated
    rows and keys, null keys included, are encoded row by row; an empty table gives no
    rows; other columns are not read. Texts are encoded whole, whatever their length.
    """
    spark = ready(docs.sparkSession)
    tok = tokenizer(path)
    words = [w.encode("utf-8") for w in frequent_words(docs, path, text, lexicon_words)]
    name = publish(spark, compile_lexicon(words, tok.merge(words)))
    source = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer(path), Lexicon(SparkFiles.get(name)))
        for batch in batches:
            for low, high, data, start in W.pieces(batch.column(1)):
                raw = data.tobytes()
                texts = [raw[a:b].decode("utf-8") for a, b in zip(start[:-1].tolist(), start[1:].tolist(), strict=True)]
                found = encoder.encode(texts)
                columns = [batch.column(0).slice(low, high - low), pa.array([n for n, _, _ in found], pa.int64())]
                if form == "array":
                    ids = [list(map(int, s.split())) for _, s, _ in found]
                    columns.append(pa.array(ids, pa.list_(pa.int32())))
                else:
                    columns.append(pa.array([s for _, s, _ in found], pa.string()))
                if decoded:
                    columns.append(pa.array([d for _, _, d in found], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"key {source.schema['key'].dataType.simpleString()}, n_tokens bigint, {_FORMS[form]}"
    schema += ", decoded string" if decoded else ""
    names = ["key", "n_tokens", _FORMS[form].split()[0], *["decoded"] * decoded]
    return source.mapInArrow(run, schema).withColumnRenamed("key", key)


def decode(rows: DataFrame, path: str, ids: str = "ids", key: str = "doc_id") -> DataFrame:
    """The key and ``decoded``: the tokens of an id array joined by one space; null ids give an empty text."""
    ready(rows.sparkSession)
    source = rows.select(F.col(f"`{key}`").alias("key"), F.col(f"`{ids}`").cast("array<int>").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = tokenizer(path).token
        for batch in batches:
            texts = [" ".join([token[i] for i in x.as_py() or []]) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["key", "decoded"])

    kind = source.schema["key"].dataType.simpleString()
    return source.mapInArrow(run, f"key {kind}, decoded string").withColumnRenamed("key", key)


def digest(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id",
        "n_tokens",
        F.sha2(F.col("ids_text").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
