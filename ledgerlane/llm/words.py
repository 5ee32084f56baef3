"""Words of whole Arrow text columns as NumPy arrays: boundaries, 64-bit hashes, n-grams.

Texts are handled as UTF-8 bytes. Both word definitions in use separate words by ASCII
bytes only, so that a byte never has to be decoded to know whether it belongs to a word.
A text is never cut: a batch is divided between rows, and a text larger than a piece is
a piece of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text taken at once (more only for a single longer text). Arrays of eight bytes per
#: byte of text come and go, so a worker's memory is some 60 times this.
PIECE_BYTES = 1 << 20

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_STEP = _U(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    x = x ^ (x >> _U(32))
    x = x * _STEP
    x = x ^ (x >> _U(29))
    x = x * _BASE
    return x ^ (x >> _U(32))


@cache
def _letters() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=_U) * _BASE)


class _Powers:
    """Powers of the base and of its inverse, grown to the longest piece seen."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, _U)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            inverse = _U(pow(int(_BASE), -1, 1 << 64))
            up, down = np.full(n, _BASE), np.full(n, inverse)
            up[0] = down[0] = 1
            self.up, self.down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        return self.up, self.down


_powers = _Powers()


@cache
def spaced() -> np.ndarray:
    """Bytes of the words ``[^\\x20\\x09-\\x0D]+``."""
    table = np.ones(256, bool)
    table[[0x20, *range(0x09, 0x0E)]] = False
    return table


@cache
def alphanumeric() -> np.ndarray:
    """Bytes of the words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``, of either case."""
    table = np.zeros(256, bool)
    for low, high in (("0", "9"), ("A", "Z"), ("a", "z")):
        table[ord(low) : ord(high) + 1] = True
    table[0x80:] = True
    return table


@cache
def _lower() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[ord("A") : ord("Z") + 1] += 32
    return table


@dataclass
class Words:
    """The words of some texts, in order.

    ``first[t] : first[t + 1]`` are the words of text t; ``start`` and ``end`` are byte
    positions in ``data``, and ``text_start[t] : text_start[t + 1]`` the bytes of text t.
    """

    data: np.ndarray
    text_start: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        if not len(self.start):
            return np.zeros(0, _U)
        up, down = _powers(len(self.data))
        total = np.zeros(len(self.data) + 1, _U)
        np.cumsum(_letters()[self.data] * up[: len(self.data)], out=total[1:])
        raw = (total[self.end] - total[self.start]) * down[self.start]
        return mix(raw + (self.end - self.start).astype(_U) * _STEP)

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def find_words(
    data: np.ndarray, text_start: np.ndarray, inside: np.ndarray, lower: bool
) -> Words:
    if lower:
        data = _lower()[data]
    mask = inside[data]
    before = np.empty(len(data) + 1, bool)
    before[0], before[1:] = False, mask
    # A text boundary separates words like a separator does.
    edge = text_start[:-1][text_start[:-1] < len(data)]
    before[edge] = False
    start = np.flatnonzero(mask & ~before[:-1])
    after = np.zeros(len(data) + 1, bool)
    after[: len(data)] = mask
    after[edge] = False
    end = np.flatnonzero(mask & ~after[1:]) + 1
    return Words(data, text_start, start, end, np.searchsorted(start, text_start))


def pieces(texts: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, start of each text and the end); null is empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    low = 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(at, at[low] + limit, "right")) - 1)
        yield low, high, data[at[low] : at[high]], at[low : high + 1] - at[low]
        low = high


def word_pieces(texts: pa.Array, inside: np.ndarray, lower: bool) -> Iterator[tuple[int, int, Words]]:
    for low, high, data, text_start in pieces(texts):
        yield low, high, find_words(data, text_start, inside, lower)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position; the last n - 1 positions have none."""
    if len(hashes) < n:
        return np.zeros(0, _U)
    size = len(hashes) - n + 1
    out = np.zeros(size, _U)
    for j in range(n):
        out = out * _STEP + hashes[j : j + size]
    return mix(out + _U(n))


def gram_starts(first: np.ndarray, n: int) -> np.ndarray:
    """Positions from which n words of one text follow."""
    size = int(first[-1]) - n + 1
    if size <= 0:
        return np.zeros(0, np.int64)
    good = np.ones(size, bool)
    # Within the last n - 1 words of a text no n words follow.
    counts = np.diff(first)
    for t in np.flatnonzero(counts):
        good[max(first[t], first[t + 1] - n + 1) : first[t + 1]] = False
    return np.flatnonzero(good)


def lower_ascii(text: str) -> str:
    """A-Z in lower case, everything else unchanged."""
    return text.translate(_LOWER)


_LOWER = {i: i + 32 for i in range(ord("A"), ord("Z") + 1)}
