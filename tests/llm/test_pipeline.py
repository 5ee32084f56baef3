"""The pipeline against a brute-force chain, and the registered queries."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry_points
import corpus_pipeline
from ledgerlane.llm import quality
from ledgerlane.llm.queries import tokenizer_path
from tests.compare import difference, duck
from tests.llm import brute
from tests.llm.conftest import DOCUMENTS, SF_DIR


def test_every_operator_is_registered():
    names = entry_points.queries()
    assert [sum(q.startswith(f"op{n}_") for q in names) for n in range(1, 11)] == [1] * 10
    assert "pipeline" in names


@pytest.mark.parametrize("name", sorted(q for q in entry_points.oracle_sql() if q.startswith("op")))
def test_twins_agree(spark, name):
    assert difference(spark, duck(SF_DIR), SF_DIR, name) is None


def test_pipeline_equals_brute_force(spark, documents):
    from pyspark.sql import functions as F
    from tokenizers import Tokenizer

    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").select("item_id", "text").collect()]
    judged = quality.classify(documents, labels, F.col("source"), F.concat_ws("/", "source", "lang")).collect()
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    kept = {r["doc_id"]: texts[r["doc_id"]] for r in judged if r["kept"]}
    kept = {d: kept[d] for d, (_, root) in brute.jaccard(kept, 5, 80, 100).items() if root == d}
    kept = {d: kept[d] for d, x in brute.contaminated(kept, items, 10).items() if not x[-1]}
    library = Tokenizer.from_file(tokenizer_path())
    expected = {}
    for d, text in kept.items():
        out, last = "", 0
        for a, _, b in brute.base_secrets(text):
            if a >= last:
                out += text[last:a] + "[SECRET]"
            last = max(last, b)
        expected[d] = library.encode(out + text[last:], add_special_tokens=False).ids
    found = {r["doc_id"]: r["ids"] for r in corpus_pipeline.run(spark, SF_DIR).collect()}
    assert found == expected


def test_stages_on_odd_rows(spark):
    rows = [
        (1, None, "en", "s", 0),
        (2, "", None, None, None),
        (None, "some plain words without anything else here", "en", "s", 43),
        (3, "token = 'abcdefghijklmnopqrst' and so on", "en", "s", 40),
        (3, "token = 'abcdefghijklmnopqrst' and so on", "en", "s", 40),
        (4, "word " * 20000, "en", "s", 100000),
    ]
    docs = spark.createDataFrame(rows, DOCUMENTS).selectExpr("*", "'x' as node", "1 as rejected")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF_DIR)
        assert out.columns == docs.columns, name
        assert stage(spark, docs.limit(0), SF_DIR).count() == 0, name
        assert None in {r["doc_id"] for r in out.collect()}, name
    found = corpus_pipeline.secrets_redacted(spark, docs, SF_DIR).where("doc_id = 3").select("text", "n_chars").distinct().collect()
    assert [tuple(r) for r in found] == [("[SECRET]' and so on", 19)]
    assert corpus_pipeline.token_ids(spark, docs, SF_DIR).count() == len(rows)


def test_planted_random_keys_are_redacted(spark, documents):
    import random

    rnd = random.Random(8)
    symbols = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    texts = {r["doc_id"]: r["text"] or "" for r in documents.collect()}
    chosen = sorted(texts)[::5][:60]
    keys = {d: "".join(rnd.choice(symbols) for _ in range(40)) for d in chosen}
    planted = spark.createDataFrame([(d, f"{t} {keys[d]} and so on" if d in keys else t) for d, t in texts.items()], "doc_id bigint, text string")
    docs = documents.drop("text").dropDuplicates(["doc_id"]).join(planted, "doc_id").select(*documents.columns)
    after = {r["doc_id"]: r["text"] for r in corpus_pipeline.secrets_redacted(spark, docs, SF_DIR).collect()}
    plain = {r["doc_id"]: r["text"] for r in corpus_pipeline.secrets_redacted(spark, documents, SF_DIR).collect()}
    assert sum(keys[d] not in after[d] for d in keys) >= 0.9 * len(keys)
    assert all(after[d] == plain[d] for d in texts if d not in keys and texts[d])
