from __future__ import annotations

import random

import pytest

SF_DIR = "/root/testdata/sf0.001"
DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r["doc_id"]: r["text"] for r in documents.select("doc_id", "text").collect()}


@pytest.fixture
def frame(spark):
    """Documents from {id: text} or (id, text) pairs, with columns whose names operators use too."""

    def build(rows):
        rows = list(rows.items()) if isinstance(rows, dict) else list(rows)
        schema = "node string, doc_id bigint, `range` int, text string, root double, n int, key string, levels binary"
        return spark.createDataFrame([("x", d, 1, t, 0.5, 2, "k", b"z") for d, t in rows], schema)

    return build


@pytest.fixture(scope="session")
def made():
    """Random texts over few words: near copies, exact copies, repeats inside, short and long ones."""
    rnd = random.Random(7)
    words = [f"w{i}" for i in range(60)] + ["É", "ß", "B", "b"]
    out: dict[int, str | None] = {}
    for d in range(60):
        if d % 3 and d > 3:
            w = out[rnd.randrange(d)].split(" ") if rnd.random() < 0.8 else []
            w = [rnd.choice(words) if rnd.random() < 0.02 else x for x in w]
        else:
            w = [rnd.choice(words) for _ in range(rnd.choice([1, 2, 5, 40, 120, 400]))]
        out[d] = " ".join(w)
    passage = " ".join(rnd.choice(words) for _ in range(55))
    for d in range(60, 80):
        out[d] = f"{rnd.random()} {passage}\t{rnd.random()}\n{passage if d % 4 == 0 else ''}"
    out |= {80: None, 81: "", 82: " \t\n", 83: out[60], 84: out[60], 85: "a " * 5000, 86: "one"}
    return out
