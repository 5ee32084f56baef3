"""Fill-in-middle against a version that lists all units."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest

from ledgerlane.llm import infill
from tests.llm.brute import sha


def plain_infill(key, text, settings=infill.Settings()):
    text = text or ""
    u = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"{settings.seed}:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    if not text or any(m in text for m in settings.marks) or h[2] % 100 >= settings.moved:
        return len(u), "plain", None, None, text
    prefix, middle, suffix = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    p, s, m = settings.marks
    if h[3] % 100 < settings.spm:
        return len(u), "spm", len(prefix), len(middle), s + suffix + p + prefix + m + middle
    return len(u), "psm", len(prefix), len(middle), p + prefix + s + suffix + m + middle


ODD = {
    200: None,
    201: "",
    202: "a <P> b",
    203: "<<S<M",
    204: "é" * 700 + "abc" * 300 + "𝄞",
    205: "x" * 5000,
    206: "\n\x00 \r\n",
    207: "ab1cd2ef",
    208: "`@[{Zz",
}


@pytest.mark.parametrize(
    "settings", [infill.Settings(), infill.Settings(seed=7, moved=100, spm=50), infill.Settings(1, 100, 0, "|p.", "|s*", "|m\\")]
)
def test_equals_the_plain_version(frame, made, settings):
    docs = made | ODD
    rows = infill.transform(frame(docs), settings).collect()
    got = {r["doc_id"]: (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in rows}
    assert got == {d: plain_infill(d, t, settings) for d, t in docs.items()}
    restored = infill.transform(frame(docs), settings).select("doc_id", infill.restore(infill.F.col("output"), infill.F.col("form"), settings)).collect()
    assert {r[0]: r[1] for r in restored} == {d: t or "" for d, t in docs.items()}


def test_very_long_text_and_repeated_rows(frame):
    text = ("word, 42 né" * 40 + "\n") * 6000
    rows = infill.digest(infill.transform(frame([(5, text), (5, text), (None, "a b"), (6, "")]))).collect()
    assert len(rows) == 4
    for r in rows:
        body = {5: text, None: "a b", 6: ""}[r["doc_id"]]
        *expected, output = plain_infill(r["doc_id"], body)
        assert tuple(r) == (r["doc_id"], *expected, sha(output), sha(body))


def test_empty_table_and_forms(frame):
    assert infill.transform(frame({})).count() == 0
    forms = [r["form"] for r in infill.transform(frame({d: f"text {d}" for d in range(2000)})).collect()]
    assert 0.87 < 1 - forms.count("plain") / 2000 < 0.93
    assert 0.16 < forms.count("spm") / (forms.count("spm") + forms.count("psm")) < 0.24


@pytest.mark.parametrize("block", [1, 3, 64])
def test_cuts_at_every_unit(block):
    """All cuts of texts laid out over blocks of several sizes, text ends inside and between blocks."""
    texts = ["abc", "", "a1b2", "éé z", "", "zz", "q" * 130, " ", "a"]
    array = pa.array([*texts, None])
    for cut in range(140):
        n, low, high = infill.cuts(array, np.full(10, cut), np.full(10, cut), block)
        for i, text in enumerate([*texts, ""]):
            u = re.findall("[A-Za-z]+|[^A-Za-z]", text)
            assert n[i] == len(u)
            assert low[i] == high[i] == len("".join(u[: cut % (len(u) + 1)]))


def test_fenwick_sums():
    rnd = np.random.default_rng(1)
    for size in (1, 2, 3, 8, 13, 100):
        counts = rnd.integers(0, 4, (size, 2))
        tree = infill.Fenwick(counts)
        sums = np.concatenate([[[0, 0]], counts.cumsum(0)])
        assert (tree.before(np.arange(size + 1)) == sums).all()
        ranks = np.arange(counts[:, 0].sum() + 1)
        block, before = tree.descend(ranks)
        for r, b, s in zip(ranks, block, before, strict=True):
            assert (s == sums[b]).all() and s[0] <= r
            assert b == size or sums[b + 1][0] > r
