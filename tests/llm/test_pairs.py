"""Joins, repeats and contamination against brute force."""

from __future__ import annotations

import numpy as np
import pytest

from ledgerlane.llm import covertree, graph, ngrams, repeats, suffixes
from tests.llm import brute


def classes(df, n, num, den):
    rows = ngrams.classes(df, n, num, den).collect()
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows}


@pytest.mark.parametrize(("n", "num", "den"), [(3, 90, 100), (5, 80, 100)])
def test_jaccard_classes(frame, made, n, num, den):
    assert classes(frame(made), n, num, den) == brute.jaccard(made, n, num, den)


def test_jaccard_dense_near_copies_in_small_tiles(frame, monkeypatch):
    """Many near copies around the threshold, tiles cut into blocks of four."""
    monkeypatch.setattr(ngrams, "TILE_SETS", 4)
    rnd = np.random.default_rng(3)
    base = [f"t{i}" for i in range(150)]
    docs = {}
    for d in range(70):
        w = list(base)
        for i in rnd.choice(150, rnd.integers(0, 6), replace=False):
            w[i] = f"x{d}-{i}"
        docs[d] = " ".join(w)
    assert classes(frame(docs), 3, 90, 100) == brute.jaccard(docs, 3, 90, 100)


def test_jaccard_keys(spark, frame):
    text = "a b c d e f g h"
    found = ngrams.classes(frame([(5, text), (5, text), (None, text), (7, "other words of its own"), (9, None)])).collect()
    got = sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"]) for r in found)
    assert got == [(-1, 6, 5), (5, 6, 5), (5, 6, 5), (7, 3, 7), (9, 0, 9)]
    assert ngrams.classes(frame({})).count() == 0


def test_bitmaps_bound_the_overlap():
    rnd = np.random.default_rng(1)
    for _ in range(50):
        a = np.unique(rnd.integers(0, 400, rnd.integers(1, 200)).astype(np.uint64))
        b = np.unique(rnd.integers(0, 400, rnd.integers(1, 200)).astype(np.uint64))
        from ledgerlane.llm.words import mix

        x, y = ngrams.bitmap(mix(a)), ngrams.bitmap(mix(b))
        words = min(len(x), len(y))
        bound = ngrams.most_overlap(ngrams.folded(x, words), ngrams.folded(y, words), len(a), len(b))
        assert bound >= len(np.intersect1d(a, b))


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(30)]
    star = [(100, 100 + i) for i in range(1, 40)]
    rows = graph.components(spark.createDataFrame(chain + star, "a bigint, b bigint")).collect()
    assert {r["node"]: r["root"] for r in rows} == {**dict.fromkeys(range(31), 0), **dict.fromkeys(range(100, 140), 100)}


def removed(df, size, kept="text"):
    rows = repeats.remove_repeats(df, size, kept=kept).collect()
    return {r["doc_id"]: (r["n_words"], r["n_removed"], r[-1]) for r in rows}


@pytest.mark.parametrize("size", [4, 20])
def test_repeats(frame, made, size):
    expected = brute.without_repeats(made, size)
    assert removed(frame(made).repartition(5), size) == expected
    digests = {d: (*x[:2], brute.sha(x[2])) for d, x in expected.items()}
    assert removed(frame(made), size, "sha256") == digests
    more = repeats.remove_repeats(frame(made), size, first_length=size // 4).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in more} == expected


def test_repeats_keys(frame):
    text = " ".join(f"w{i}" for i in range(30))
    rows = repeats.remove_repeats(frame([(3, text), (3, text), (1, "own " + text), (None, text), (4, text)])).collect()
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in rows)
    assert got == [(-1, 30, 0, text), (1, 31, 30, "own"), (3, 30, 30, ""), (3, 30, 30, ""), (4, 30, 30, "")]
    assert repeats.remove_repeats(frame({})).count() == 0


def test_least_positions():
    rnd = np.random.default_rng(2)
    for width in (1, 2, 3, 11, 16):
        v = rnd.integers(0, 5, 60).astype(np.uint64)
        assert repeats.least_positions(v, width).tolist() == [i + int(v[i : i + width].argmin()) for i in range(61 - width)]


ITEMS = [(1, "w1 W2 w3"), (2, "É b, ß w7"), (2, "É b, ß w7"), (None, "w9 w9"), (10, None), (11, "..."), (12, "only in the test item")]


def matches(found):
    return {r["doc_id"]: tuple(r)[1:] for r in suffixes.digest(found).collect()}


@pytest.mark.parametrize("block_bytes", [300, 1 << 20])
def test_decontamination(spark, frame, made, texts, block_bytes):
    items = [*ITEMS, (20, " ".join(made[0].split(" ")[:30])), (21, made[60])]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    found = suffixes.search(frame(made), bench, window=10, block_bytes=block_bytes)
    assert matches(found) == brute.contaminated(made, items, 10)
    assert found.columns[:-1] == frame({}).columns
    kept = suffixes.decontaminate(frame(made), bench).select("doc_id").collect()
    assert {r[0] for r in kept} == {d for d, x in brute.contaminated(made, items, 10).items() if not x[-1]}


def test_longest_match_and_empty_tables(spark, frame):
    bench = spark.createDataFrame([(7, "a b c d e f g h i j k l m")], "item_id bigint, text string")
    row = suffixes.search(frame({1: "x b c d e f g h i j k l m y"}), bench).first()["benchmark_match"]
    assert row["longest"].asDict() == {"item_id": 7, "item_word": 1, "word": 1, "length": 12}
    assert [tuple(s) for s in row["spans"]] == [(1, 13)]
    assert matches(suffixes.search(frame({1: "a b"}), bench.limit(0))) == {1: (2, 0, 0, brute.sha(""), False)}
    assert suffixes.search(frame({}), bench).count() == 0


def test_text_item_ids_and_repeated_items(spark, frame, made):
    passage = " ".join(made[60].split()[:30])
    items = [("b10", passage), ("b9", passage + " more"), (None, "w9 w9")] + [("b10", passage)] * 500
    bench = spark.createDataFrame(items, "item_id string, text string")
    assert sum(len(ids) for ids, _ in suffixes.blocks(bench, "item_id", "text", 1 << 20)) == 3
    found = suffixes.search(frame(made), bench)
    assert matches(found) == brute.contaminated(made, items, 10)
    assert found.where("doc_id = 60").first()["benchmark_match"]["longest"]["item_id"] in ("b10", "b9")


def vectors(df, **options):
    return {r["vec_id"]: (r["n_links"], r["component_id"]) for r in covertree.near_duplicates(df, **options).collect()}


@pytest.mark.parametrize("rows", [16, 8192])
def test_near_vectors(spark, rows):
    rnd = np.random.default_rng(5)
    made = {}
    for k in range(150):
        if k % 3 == 0 or k < 5:
            made[k] = rnd.normal(size=8).tolist()
        else:
            made[k] = (np.array(made[int(rnd.integers(0, k))]) + rnd.normal(size=8) * rnd.choice([0.0, 0.1, 0.3])).tolist()
    made |= {200: None, 201: [], 202: [0.0] * 8, 203: [float("nan")] * 8, 204: [None] + [1.0] * 7, 205: [1.0, 2.0]}
    made |= {206: [x * 1e200 for x in made[0]], 207: [float("inf")] + [0.0] * 7}
    df = spark.createDataFrame([(0.5, k, v, "x") for k, v in made.items()], "cell double, vec_id bigint, embedding array<double>, point string")
    finite = {k: [x / 1e200 for x in v] if k == 206 else v for k, v in made.items()}
    assert vectors(df, rows=rows) == brute.near_vectors(finite, 0.9)


def test_near_vectors_of_hot_group_and_empty_table(spark):
    schema = "vec_id bigint, embedding array<float>"
    rows = [(k, [1.0, 0.0, 0.001 * (k % 7)]) for k in range(90)] + [(None, [0.0, 1.0, 0.0])]
    found = covertree.near_duplicates(spark.createDataFrame(rows, schema), rows=8).collect()
    assert {tuple(r) for r in found if r["vec_id"] is not None} == {(k, 89, 0) for k in range(90)}
    assert [tuple(r) for r in found if r["vec_id"] is None] == [(None, 0, None)]
    assert vectors(spark.createDataFrame([], schema)) == {}


def test_vectors_link_within_every_length(spark):
    vectors = {1: [1.0, 0.0], 2: [1.0, 0.01], 3: [0.0, 1.0], 4: [0.0, 1.0], 5: [1.0, 0.0, 0.0], 6: [2.0, 0.0, 0.0], 7: [3.0], 8: [1.0], 9: [0.0], 10: None}
    df = spark.createDataFrame(list(vectors.items()), "vec_id bigint, embedding array<double>")
    rows = covertree.near_duplicates(df).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in rows} == brute.near_vectors(vectors, 0.9)
    assert len(rows) == len(vectors)


def test_nodes_split_level_by_level(spark, monkeypatch):
    """Few sampled points a node, so that cells are larger than a block and are split again."""
    monkeypatch.setattr(covertree, "SAMPLE", 6)
    levels = []
    split = covertree._split
    monkeypatch.setattr(covertree, "_split", lambda held, rows, level: levels.append(level) or split(held, rows, level))
    rnd = np.random.default_rng(8)
    centres = rnd.normal(size=(6, 5))
    made = {k: (centres[rnd.integers(0, 6)] + rnd.normal(size=5) * rnd.choice([0.05, 0.5])).tolist() for k in range(240)}
    # A third lies at one place: multiples of one vector, which no centres tell apart.
    made |= {1000 + k: [2.0 ** (k - 40), 0.0, 0.0, 0.0, 0.0] for k in range(80)}
    # Another length with a tree of its own.
    made |= {2000 + k: rnd.normal(size=3).tolist() for k in range(40)}
    df = spark.createDataFrame([(k, v) for k, v in made.items()], "vec_id bigint, embedding array<double>")
    assert vectors(df, rows=8) == brute.near_vectors(made, 0.9)
    assert len(levels) > 2


def test_cosine_of_exactly_the_threshold_links(spark):
    made = {1: [1.0, 0.0], 2: [0.6, 0.8], 3: [3.0, 4.0], 4: [0.6, 0.8 + 1e-6]}
    df = spark.createDataFrame(list(made.items()), "vec_id bigint, embedding array<double>")
    assert vectors(df, least=0.6) == {1: (2, 1), 2: (3, 1), 3: (3, 1), 4: (2, 1)}


def test_children_hold_a_bounded_number_of_points():
    assert covertree.children_of([3, 4, 9, 1, 5, 5, 1], 8) == [[0, 1], [2], [3, 4], [5, 6]]
    assert covertree.children_of([20], 8) == [[0]]
