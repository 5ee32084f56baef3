"""Fill-in-middle: texts cut into prefix, middle and suffix at unit boundaries, and put in another order.

A unit is a run of ASCII letters or any other single code point. Where the two cuts of a text
fall, and which form it takes, follows from a hash of its id, so that a run repeats itself.

Cuts are found by counts, without a list of units:

1. The bytes of a piece (whole texts, one behind the other) are divided into fixed blocks. Each
   block's numbers of unit starts and of code points go into a Fenwick tree.
2. Sums over the blocks before a text's start tell the rank of its first unit, and so how
   many units it has.
3. A cut behind k units is where the unit of that rank starts. A binary-lifting descent of the
   tree finds its block and the code points before it; the place within the block is
   read from the block alone. All cuts of a piece descend together.

Workers return three numbers per text. The texts stay in the JVM, where the output is put
together and, by ``restore``, taken apart again.

Results for odd rows: a null or empty text has no units and is left plain; a null id is hashed
like an empty one; rows that share an id are cut by the same hash; an empty table gives an
empty result; columns other than the id and the text are not looked at. Memory is a few bytes
per byte of the largest text, or of a piece of 1 MB.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlane.llm.words import pieces

#: Bytes of a block.
BLOCK = 256

PLAIN, PSM, SPM = "plain", "psm", "spm"


@dataclass(frozen=True)
class Settings:
    """Marks, and what part of the texts takes which form, in percent.

    ``moved`` percent of the texts are taken apart; of these ``spm`` percent put the suffix first.
    A mark must not start with its own end, and no mark may hold or overlap another.
    """

    seed: int = 1
    moved: int = 90
    spm: int = 20
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    @property
    def marks(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


class Fenwick:
    """Sums over the first blocks of a row of blocks, for several counts at once."""

    def __init__(self, counts: np.ndarray) -> None:
        self.size = len(counts)
        self.tree = np.zeros((self.size + 1, counts.shape[1]), np.int64)
        self.tree[1:] = counts
        step = 1
        while 2 * step <= self.size:
            at = np.arange(2 * step, self.size + 1, 2 * step)
            self.tree[at] += self.tree[at - step]
            step *= 2

    def before(self, block: np.ndarray) -> np.ndarray:
        """The counts of all blocks before each given one."""
        at, total = block.astype(np.int64), np.zeros((len(block), self.tree.shape[1]), np.int64)
        while at.any():
            total += self.tree[at]
            at = at & (at - 1)
        return total

    def descend(self, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The block in which the entry of each rank (of the first count) lies, and the counts before it.

        A rank as large as the total gives the block behind the last.
        """
        at, total = np.zeros(len(rank), np.int64), np.zeros((len(rank), self.tree.shape[1]), np.int64)
        step = 1 << self.size.bit_length()
        while step:
            to = at + step
            inside = np.flatnonzero(to <= self.size)
            sums = total[inside] + self.tree[to[inside]]
            good = sums[:, 0] <= rank[inside]
            at[inside[good]] = to[inside[good]]
            total[inside[good]] = sums[good]
            step //= 2
        return at, total


class Units:
    """Unit and code-point counts of the texts of one piece."""

    def __init__(self, data: np.ndarray, text_start: np.ndarray, block: int = BLOCK) -> None:
        self.block, self.text_start = block, text_start
        points = (data & 0xC0) != 0x80
        letter = ((data | 0x20) >= ord("a")) & ((data | 0x20) <= ord("z"))
        inner = np.zeros(len(data), bool)
        inner[1:] = letter[1:] & letter[:-1]
        inner[text_start[:-1][text_start[:-1] < len(data)]] = False
        # One block more than the data fills: the place behind the last unit.
        self.blocks = len(data) // block + 1
        self.starts = np.zeros((self.blocks, block), bool)
        self.points = np.zeros((self.blocks, block), bool)
        self.starts.reshape(-1)[: len(data)] = points & ~inner
        self.points.reshape(-1)[: len(data)] = points
        sums = [m.sum(1, dtype=np.int64) for m in (self.starts, self.points)]
        self.tree = Fenwick(np.column_stack(sums))
        self.total = np.array([sums[0].sum(), sums[1].sum()])
        #: Unit and code-point ranks at the start of every text, and at the end.
        self.at_start = self._ranks(text_start)

    def _ranks(self, byte: np.ndarray) -> np.ndarray:
        block, rest = byte // self.block, byte % self.block
        before = np.arange(self.block) < rest[:, None]
        local = [(m[block] & before).sum(1) for m in (self.starts, self.points)]
        return self.tree.before(block) + np.column_stack(local)

    @property
    def counts(self) -> np.ndarray:
        """Units of each text."""
        return np.diff(self.at_start[:, 0])

    def points_before(self, text: np.ndarray, cut: np.ndarray) -> np.ndarray:
        """Code points of each given text before the unit numbered ``cut`` in it."""
        rank = self.at_start[text, 0] + cut
        block, before = self.tree.descend(rank)
        out = np.empty(len(rank), np.int64)
        behind = block >= self.blocks
        out[behind] = self.total[1]
        near = np.flatnonzero(~behind)
        seen = np.cumsum(self.starts[block[near]], axis=1, dtype=np.int32)
        wanted = (rank[near] - before[near, 0] + 1)[:, None]
        place = (seen >= wanted).argmax(1)
        upto = np.arange(self.block) < place[:, None]
        out[near] = before[near, 1] + (self.points[block[near]] & upto).sum(1)
        return out - self.at_start[text, 1]


def cuts(texts: pa.Array, first: np.ndarray, second: np.ndarray, block: int = BLOCK) -> list[np.ndarray]:
    """Units of each text, and the code points before its earlier and its later cut.

    The cuts are two hashes, each reduced to 0 … units.
    """
    out = [np.zeros(len(texts), np.int64) for _ in range(3)]
    for low, high, data, text_start in pieces(texts):
        units = Units(data, text_start, block)
        n = units.counts
        a, b = first[low:high] % (n + 1), second[low:high] % (n + 1)
        text = np.arange(high - low)
        out[0][low:high] = n
        out[1][low:high] = units.points_before(text, np.minimum(a, b))
        out[2][low:high] = units.points_before(text, np.maximum(a, b))
    return out


@F.arrow_udf(T.StructType([T.StructField(c, T.LongType()) for c in ("n", "low", "high")]))
def _cuts(texts: pa.Array, first: pa.Array, second: pa.Array) -> pa.Array:
    found = cuts(texts, first.to_numpy(zero_copy_only=False), second.to_numpy(zero_copy_only=False))
    return pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in found], names=["n", "low", "high"])


def _hash(digest: Column, group: int) -> Column:
    """One of the groups of eight hexadecimal digits as a number."""
    return F.conv(F.substring(digest, 8 * group + 1, 8), 16, 10).cast("bigint")


def transform(docs: DataFrame, settings: Settings = Settings(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text, n, form, prefix_chars, middle_chars, output) per row; a null text counts as empty.

    n is the number of units. ``form`` is plain where the text is empty, holds a mark, or is among
    the part left as it is; then the two lengths are null and the output is the text.
    """
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    named = F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{settings.seed}:"), named), 256)
    rows = docs.select(F.col(f"`{key}`").alias("key"), whole.alias("text"), digest.alias("digest"))
    rows = rows.withColumn("cut", _cuts("text", _hash(F.col("digest"), 0), _hash(F.col("digest"), 1)))
    body = F.col("text")
    marked = F.lit(False)
    for mark in settings.marks:
        marked = marked | F.contains(body, F.lit(mark))
    left = (body == "") | marked | (_hash(F.col("digest"), 2) % 100 >= settings.moved)
    suffix_first = _hash(F.col("digest"), 3) % 100 < settings.spm
    rows = rows.select(
        "key",
        "text",
        F.col("cut.n").alias("n"),
        F.when(left, PLAIN).when(suffix_first, SPM).otherwise(PSM).alias("form"),
        F.col("cut.low").alias("low"),
        F.col("cut.high").alias("high"),
    )
    moved = F.col("form") != PLAIN
    low, high = F.col("low").cast("int"), F.col("high").cast("int")
    prefix, middle = F.substr(body, F.lit(1), low), F.substr(body, low + 1, high - low)
    suffix = F.substr(body, high + 1)
    p, s, m = (F.lit(x) for x in settings.marks)
    output = (
        F.when(F.col("form") == PSM, F.concat(p, prefix, s, suffix, m, middle))
        .when(F.col("form") == SPM, F.concat(s, suffix, p, prefix, m, middle))
        .otherwise(body)
    )
    return rows.select(
        F.col("key").alias(key),
        F.col("text").alias(text),
        "n",
        "form",
        F.when(moved, F.col("low")).alias("prefix_chars"),
        F.when(moved, F.col("high") - F.col("low")).alias("middle_chars"),
        output.alias("output"),
    )


def restore(output: Column, form: Column, settings: Settings = Settings()) -> Column:
    """The text behind an output: taken apart at its marks, which no moved text holds otherwise."""
    mark = "|".join(_java_quoted(x) for x in settings.marks)
    part = F.split(output, mark, -1)
    return (
        F.when(form == PSM, F.concat(part[1], part[3], part[2]))
        .when(form == SPM, F.concat(part[2], part[3], part[1]))
        .otherwise(output)
    )


def _java_quoted(mark: str) -> str:
    return re.sub(r"([^A-Za-z0-9])", r"\\\1", mark)


def digest(found: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """What ``transform`` gives, with hashes of the output and of the text restored from it."""
    restored = restore(F.col("output"), F.col("form"), settings)
    return found.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored, 256).alias("restored_sha256"),
    )
