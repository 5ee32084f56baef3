"""The corpus pipeline: five stages, each calling one operator on all that the stage before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of ``documents``. Stages remove rows by id: rows that share an id go or stay
together, and rows without an id, which no decision can name, stay. Null texts count as
empty, repeated rows are treated alike, an empty table passes through, and further
columns of any name are dropped by none of the filtering stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlane.llm import bpe, ngrams, quality, secrets, suffixes
from ledgerlane.llm.jobs import ready, stored
from ledgerlane.llm.queries import table, tokenizer_path


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """``docs`` without the ids in ``rejected``, which is written first so that its size is known."""
    names = stored(rejected.select(F.col("doc_id").alias("rejected_id")).where("rejected_id is not null").distinct(), "rejected")
    return docs.join(names, docs["doc_id"] == names["rejected_id"], "left_anti")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of good quality that are not toxic; sites are sources, paths source and language."""
    path = F.concat_ws("/", "source", "lang")
    found = quality.classify(docs, table(spark, sf_dir, "labels"), F.col("source"), path)
    return _without(docs, found.where("not kept"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 over five-word shingles, the one with the least id."""
    found = ngrams.classes(docs, n=5, num=80, den=100)
    return _without(docs, found.where("doc_id <> component_id"))


def not_in_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without ten consecutive words of a test item."""
    return suffixes.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secrets_redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret replaced by a mark and n_chars counted anew where one was."""
    found = secrets.scan(docs)
    # Columns of the frame itself: by name alone, n_chars would be counted on the text already replaced.
    text, spans = found["text"], found["secret_spans"]
    some = F.size(spans) > 0
    clean = F.when(some, secrets.redact(F.coalesce(text, F.lit("")), spans)).otherwise(text)
    size = F.when(some, F.length(clean).cast("bigint")).otherwise(found["n_chars"])
    columns = [clean.alias(c) if c == "text" else size.alias(c) if c == "n_chars" else found[c] for c in docs.columns]
    return found.select(*columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids): every text encoded."""
    return bpe.encode(docs, tokenizer_path(), form="array")


STAGES = [
    ("quality_classifier", good_quality),
    ("ngram_jaccard", one_of_each_group),
    ("decontamination", not_in_benchmark),
    ("secret_scan", secrets_redacted),
    ("bpe", token_ids),
]

#: SQL cannot fit the classifier or merge words; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each result is written once for the next stage."""
    docs = table(ready(spark), sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, f"stage-{name}")
    return docs
