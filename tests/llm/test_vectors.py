"""Whitening and top-k search against plain versions; eigenvectors against a library's."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlane.llm import eigen, integers, topk, whitening

NAN, INF = float("nan"), float("inf")
SCHEMA = "dim int, vec_id bigint, embedding array<double>, x string, asks int"


@pytest.fixture
def vectors(spark):
    """A table whose further columns have names that operators use too."""

    def build(rows):
        rows = list(rows.items()) if isinstance(rows, dict) else list(rows)
        return spark.createDataFrame([(1, k, v, "x", 2) for k, v in rows], SCHEMA)

    return build


def good(v):
    return v is not None and all(c is not None and math.isfinite(c) for c in v)


def made(n, d, seed=3):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(5, d))
    x = centres[rnd.integers(0, 5, n)] + rnd.normal(size=(n, d)) * 0.2
    x[n // 2 :: 3] = x[0]
    return {int(k): x[k].tolist() for k in range(n)}


ODD = {900: None, 901: [NAN] + [0.0] * 5, 902: [INF] + [0.0] * 5, 903: [None] + [1.0] * 5, 904: [], 905: [0.0] * 6}


def random_matrices():
    rnd = np.random.default_rng(0)
    for n in (1, 2, 3, 17, 64):
        x = rnd.normal(size=(3 * n, n))
        yield x.T @ x
    q, _ = np.linalg.qr(rnd.normal(size=(40, 40)))
    yield q @ np.diag([5.0] * 8 + [3.0] * 8 + [1.0] * 24) @ q.T
    yield q @ np.diag(10.0 ** -np.arange(40)) @ q.T
    yield np.eye(20)
    yield np.diag(np.arange(25.0))
    yield np.ones((9, 9))
    yield np.zeros((4, 4))
    yield -np.eye(6)
    x = rnd.normal(size=(3, 30))
    yield x.T @ x
    yield 1e200 * (x.T @ x)
    twin = np.zeros((24, 24))
    twin[:12, :12] = twin[12:, 12:] = (q[:12] @ np.diag(np.arange(40.0)) @ q[:12].T)
    yield twin


@pytest.mark.parametrize("matrix", list(random_matrices()), ids=str)
def test_leading_eigenvectors(matrix):
    matrix = (matrix + matrix.T) / 2
    values, found = eigen.leading(matrix, 16)
    expected = np.linalg.eigvalsh(matrix)[::-1][:16]
    size = np.abs(np.linalg.eigvalsh(matrix)).max() or 1.0
    assert np.abs(values - expected).max() <= 1e-13 * size
    assert np.abs(matrix @ found.T - found.T * values).max() <= 1e-13 * size
    assert np.abs(found @ found.T - np.eye(len(found))).max() <= 1e-12


def test_sturm_counts():
    rnd = np.random.default_rng(4)
    d, e = rnd.normal(size=30), rnd.normal(size=29)
    e[11] = 0.0
    own = np.linalg.eigvalsh(np.diag(d) + np.diag(e, 1) + np.diag(e, -1))
    at = np.concatenate([[-9.0, 9.0], (own[1:] + own[:-1]) / 2])
    assert eigen.counts_below(d, e, at).tolist() == [0, 30, *range(1, 30)]


def plain_whitening(rows, count):
    """(n, deviation, projection without signs, explained) per length and id."""
    out = {}
    for d in {len(v) for _, v in rows if good(v)} - {0}:
        own = [(k, v) for k, v in rows if good(v) and len(v) == d]
        x = np.floor(64 * np.array([v for _, v in own])).astype(int) + 1_000_000
        fit = np.unique(x, axis=0)
        n, s = len(fit), fit.sum(0)
        centred = fit - s / n
        values, vecs = np.linalg.eigh(centred.T @ centred / n)
        values, vecs = values[::-1][:count], vecs[:, ::-1][:, :count]
        out[d] = n, ((n * x - s) ** 2).sum(1), np.abs((x - s / n) @ vecs / np.sqrt(np.maximum(values, 1e-300))), values / max(np.trace(centred.T @ centred / n), 1e-300), [k for k, _ in own]
    return out


def test_whitening_equals_the_plain_version(vectors):
    rows = [*made(150, 6).items(), *ODD.items(), (None, [1.0, 2.0, 3.0, 4.0, 5.0, 7.0]), (3, made(150, 6)[4])]
    rows += [(2000 + k, v) for k, v in made(40, 3, 8).items()]
    found = whitening.whiten(vectors(rows), components=5).collect()
    for d, (n, deviation, size, explained, keys) in plain_whitening(rows, 5).items():
        own = [r for r in found if len(r["whitened"]) == min(d, 5)]
        assert sorted(map(str, (r["vec_id"] for r in own))) == sorted(map(str, keys))
        assert {r["n"] for r in own} == {n}
        assert {r["identity_error"] for r in own}.pop() < 1e-10
        expected = sorted((str(k), int(v), *np.round(w, 8)) for k, v, w in zip(keys, deviation, size, strict=True))
        got = sorted((str(r["vec_id"]), r["deviation"], *np.round(np.abs(r["whitened"]), 8)) for r in own)
        assert [g[:2] for g in got] == [e[:2] for e in expected]
        assert np.allclose([g[2:] for g in got], [e[2:] for e in expected], atol=1e-7)
        assert np.allclose(own[0]["explained"], explained, rtol=1e-9)
    # The sign is one for all rows: projections keep their inner products.
    one = {r["vec_id"]: r["whitened"] for r in found if r["vec_id"] in (0, 1)}
    x = np.floor(64 * np.array([made(150, 6)[k] for k in (0, 1)])) + 1_000_000
    fit = np.unique(np.floor(64 * np.array([v for _, v in rows if good(v) and len(v) == 6])) + 1_000_000, axis=0)
    values, vecs = np.linalg.eigh(np.cov(fit.T, bias=True))
    y = (x - fit.mean(0)) @ vecs[:, ::-1][:, :5] / np.sqrt(values[::-1][:5])
    assert np.isclose(np.dot(one[0], one[1]), y[0] @ y[1])


def test_whitening_in_groups_of_lengths(vectors):
    rows = {k: v[: 2 + k % 4] for k, v in made(200, 6).items()}
    one, many = (whitening.whiten(vectors(rows), group_bytes=size).collect() for size in (1, 1 << 30))
    assert {r["vec_id"]: (r["n"], r["deviation"]) for r in one} == {r["vec_id"]: (r["n"], r["deviation"]) for r in many}
    assert {len(r["whitened"]) for r in one} == {2, 3, 4, 5}


def test_whitening_without_variance(vectors):
    found = whitening.digest(whitening.whiten(vectors([(k, [0.5, 0.25, 0.0]) for k in range(40)]))).collect()
    assert len(found) == 120
    assert {tuple(r)[1:] for r in found} == {(c, 1, 0, None, 0.0, 0.0) for c in (1, 2, 3)}
    line = whitening.whiten(vectors({k: [k / 8, k / 4, 0.0] for k in range(30)})).collect()
    assert all(r["whitened"][0] is not None and r["whitened"][1:] == [None, None] for r in line)
    assert {r["identity_error"] for r in line}.pop() < 1e-12
    assert whitening.whiten(vectors({})).count() == whitening.whiten(vectors({1: None, 2: []})).count() == 0


def test_deviations_beyond_fast_arithmetic():
    space = whitening.Space(10**7, (10**13 + 3, 10**13 - 5))
    x = np.array([[10**6 + 70, 10**6 - 3], [10**6 + 900, 10**6]])
    assert space.deviations(x) == [sum((10**7 * int(a) - s) ** 2 for a, s in zip(v, space.sums, strict=True)) for v in x[:1].tolist()] + [None]


def plain_topk(rows, every, k):
    usable = [(i, tuple(int(math.floor(64 * c)) for c in v)) for i, v in rows if i is not None and good(v)]
    out = []
    for i, q in {(i, v) for i, v in usable if i % every == 0}:
        scores = [(-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in usable if j != i and len(v) == len(q)]
        out += [(i, rank, j, -s) for rank, (s, j) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("sizes", [(4, 16, 4, 1), (16, 64, 8, 1 << 20), (1024, 4096, 64, 1 << 20)])
def test_topk_equals_the_plain_version(vectors, sizes):
    pivots, shard, block, query_bytes = sizes
    rows = [*made(220, 6).items(), *ODD.items(), (None, [9.0] * 6), (8, made(220, 6)[8]), (9, made(220, 6)[8]), (8, [0.5] * 6)]
    rows += [(1000 + k, v) for k, v in made(12, 3, 8).items()] + [(2000, [1.0])]
    found = topk.search(vectors(rows), F.col("vec_id") % 20 == 0, 7, pivots=pivots, shard=shard, block=block, query_bytes=query_bytes)
    assert sorted(map(tuple, found.collect())) == plain_topk(rows, 20, 7)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]


def test_topk_of_a_hot_vector(vectors):
    """A third of the rows are one vector: ties go to the smallest ids."""
    rnd = np.random.default_rng(2)
    rows = [(k, [1.0, 1.0, 1.0] if k % 3 else rnd.normal(size=3).tolist()) for k in range(400)]
    found = topk.search(vectors(rows), F.col("vec_id") % 20 == 0, 20, pivots=8, shard=32, block=8).collect()
    assert sorted(map(tuple, found)) == plain_topk(rows, 20, 20)


def test_topk_of_few_rows_and_large_numbers(vectors):
    assert topk.search(vectors({}), F.col("vec_id") % 20 == 0).count() == 0
    assert topk.search(vectors({1: [1.0], 3: [2.0]}), F.col("vec_id") % 20 == 0).count() == 0
    assert topk.search(vectors({0: [1.0], 40: None}), F.col("vec_id") % 20 == 0).count() == 0
    big = {20: [3e7, -3e7], 1: [3e7, 3e7 + 1], 2: [-5.0, 2.5e7]}
    found = topk.search(vectors(big), F.col("vec_id") == 20).collect()
    assert sorted(map(tuple, found)) == plain_topk(list(big.items()), 20, 20)
    with pytest.raises(OverflowError):
        integers.multiplied(np.full((1, 4), 2**40), np.full((1, 4), 2**40))


def test_bounds_hold_and_prune():
    rnd = np.random.default_rng(6)
    centres = rnd.normal(size=(40, 16)) * 60
    x = np.concatenate([c + rnd.normal(size=(64, 16)) for c in centres]).astype(np.int64)
    shard = topk.Shard(np.arange(len(x)), np.ones(len(x), bool), x)
    assert (shard.bounds(x[:50]).repeat(64, axis=1) >= x[:50] @ x.T).all()
    best = topk.Best(np.arange(50), x[:50], 10)
    assert topk.scan(shard, best, np.arange(50)) < 50 * 40 / 4
