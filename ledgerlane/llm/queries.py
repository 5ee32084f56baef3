"""The registered queries of the subpackage: thin callers of the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlane.llm import (
    bpe,
    covertree,
    infill,
    licenses,
    ngrams,
    privacy,
    quality,
    repeats,
    scoring,
    secrets,
    suffixes,
    topk,
    whitening,
)
from ledgerlane.llm.jobs import ready
from ledgerlane.llm.oracle import all_oracles  # noqa: F401  (the entry points read both here)

#: Folder of the public tokenizer files; never copied into the repository.
TOKENIZER = "word_bpe_49k.json"

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path(TOKENIZER))


def op1_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.digest(privacy.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), privacy.DEMO_KEY))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.classes(table(spark, sf_dir, "documents"), n=3, num=90, den=100)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bpe.digest(bpe.encode(docs, tokenizer_path(), form="text", decoded=True))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffixes.digest(suffixes.search(docs, table(spark, sf_dir, "benchmark"), keep_text=False))


def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score(table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"), window=20, kept="sha256")


def op8_embedding_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = covertree.near_duplicates(table(spark, sf_dir, "embeddings"), least=0.9)
    return found.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.scan(table(spark, sf_dir, "documents")))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", "source", "lang")
    return quality.classify(docs, table(spark, sf_dir, "labels"), F.col("source"), path)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.digest(infill.transform(table(spark, sf_dir, "documents")))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.digest(whitening.whiten(table(spark, sf_dir, "embeddings"), components=16))


def op13_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def all_queries() -> dict[str, Query]:
    return {
        f.__name__: f
        for f in (
            op1_pii_pseudonyms,
            op2_secret_scan,
            op3_ngram_jaccard,
            op4_bpe,
            op5_decontamination,
            op6_language_model,
            op7_substring_dedup,
            op8_embedding_duplicates,
            op9_license_scan,
            op10_quality_classifier,
            op11_fill_in_middle,
            op12_embedding_whitening,
            op13_topk_search,
        )
    }
