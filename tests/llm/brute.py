"""Plain, slow versions of the operators' contracts, written from their texts."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


class Union:
    def __init__(self, nodes):
        self.up = {n: n for n in nodes}

    def find(self, n):
        while self.up[n] != n:
            n = self.up[n]
        return n

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def jaccard(docs: dict[int, str | None], n: int, num: int, den: int) -> dict[int, tuple[int, int]]:
    sets = {}
    for d, text in docs.items():
        w = SPACED.findall(lower(text or ""))
        sets[d] = {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()
    union = Union(sets)
    having: dict[tuple, list[int]] = {}
    for d in sorted(sets):
        both: Counter[int] = Counter()
        for s in sets[d]:
            both.update(having.get(s, ()))
            having.setdefault(s, []).append(d)
        for other, k in both.items():
            if den * k >= num * (len(sets[d]) + len(sets[other]) - k):
                union.join(d, other)
    return {d: (len(s), union.find(d)) for d, s in sets.items()}


def contaminated(docs: dict[int, str | None], items: list[tuple[int | None, str | None]], size: int):
    windows: dict[tuple, set] = {}
    for item, text in items:
        w = ALNUM.findall(lower(text or ""))
        k = min(size, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + k]), set()).add(item)
    lengths = {len(w) for w in windows}
    out = {}
    for d, text in docs.items():
        w = ALNUM.findall(lower(text or ""))
        hit, found = set(), set()
        for k in lengths:
            for i in range(len(w) - k + 1):
                if tuple(w[i : i + k]) in windows:
                    hit.update(range(i, i + k))
                    found |= windows[tuple(w[i : i + k])]
        found.discard(None)
        out[d] = (len(w), len(hit), len(found), sha(",".join(sorted(map(str, found)))), bool(hit))
    return out


def without_repeats(docs: dict[int, str | None], size: int):
    seen, out = set(), {}
    for d in sorted(docs):
        w = SPACED.findall(docs[d] or "")
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            key = tuple(w[i : i + size])
            if key in seen:
                gone[i : i + size] = [True] * size
            seen.add(key)
        out[d] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g))
    return out


def unigram(docs: dict[int, str | None]):
    words = {d: [*SPACED.findall(lower(t or "")), None] for d, t in docs.items()}
    out_of = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in docs}
    counts: Counter = Counter()
    for d, w in words.items():
        if not out_of[d]:
            counts.update(w)
    total, distinct = sum(counts.values()), len(counts)
    return {
        d: (
            out_of[d],
            len(w),
            sum(counts[x] > 0 for x in w),
            total,
            sum(math.log10((counts[x] + 1) / (total + distinct + 1)) for x in w),
        )
        for d, w in words.items()
    }


def base_secrets(text: str) -> list[tuple[int, int, int]]:
    assign = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    spans = [(m.start(), 0, m.end()) for m in re.finditer(assign, text, re.I | re.A) if len(m[2]) >= 12]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(spans)


def near_vectors(vectors: dict[int, list | None], least: float):
    good = {
        k: np.array(v, float)
        for k, v in vectors.items()
        if v and all(x is not None and math.isfinite(x) for x in v) and any(v)
    }
    union, links = Union(vectors), Counter()
    keys = sorted(good)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            x, y = good[a], good[b]
            if len(x) == len(y) and x @ y / math.sqrt((x @ x) * (y @ y)) >= least:
                links[a] += 1
                links[b] += 1
                union.join(a, b)
    return {k: (links[k], union.find(k)) for k in vectors}
