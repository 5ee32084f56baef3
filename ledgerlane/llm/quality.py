"""Quality and toxicity of documents: a classifier's evidence shrunk towards its site's rate.

1. A classifier is fitted on at most TRAIN_ROWS labelled documents (those with the least
   hash of their id): per label a logistic regression over text-shape measures and the
   hashed words that tell the classes apart. Its weights are a table of fixed size.
2. It scores every document: evidence in log-odds, one scan, no shuffle.
3. Scores are summed per host and per path (grouped aggregation, combined in each task).
   The rate of a host is shrunk towards the global rate, that of a path towards its host's,
   with a strength estimated from how far rates differ beyond what chance explains
   (method of moments), so that sparse sites follow their parents and dense ones speak
   for themselves. A document's own score is left out of its site's rate.
4. Posterior log-odds = evidence + logit(path's rate) - logit(global rate).

A document is kept when good with probability one half or more, and toxic with less.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlane.llm import words as W
from ledgerlane.llm.jobs import ready, stored

#: Labelled documents used for fitting, at most.
TRAIN_ROWS = 8000
#: Hash buckets of words, and how many of them a classifier uses.
BUCKETS = 1 << 18
USED_BUCKETS = 256
SHAPES = 9
#: Bounds on the strength, in documents, with which a parent's rate counts.
WEAKEST, STRONGEST = 10.0, 10_000.0


@dataclass
class Classifier:
    """Weights of one label; ``word`` has one per bucket."""

    word: np.ndarray
    shape: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    bias: float

    def evidence(self, shapes: np.ndarray, text: np.ndarray, bucket: np.ndarray, n: int) -> np.ndarray:
        """Log-odds of each of n documents; (text, bucket) are distinct pairs."""
        z = np.clip((shapes - self.mean) / self.scale, -6, 6) @ self.shape + self.bias
        return z + np.bincount(text, self.word[bucket], n)


def _class_table(*ranges: str) -> np.ndarray:
    table = np.zeros(256, np.int64)
    for r in ranges:
        table[ord(r[0]) : ord(r[-1]) + 1] = 1
    return table


def features(data: np.ndarray, found: W.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shape measures per text, and the distinct (text, bucket) pairs of its words.

    ``data`` are the texts as they are, ``found`` their words in lower case.
    """
    n = len(found.first) - 1
    bounds = found.text_start
    size = np.maximum(np.diff(bounds), 1).astype(float)

    def share(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags)])
        return (total[bounds[1:]] - total[bounds[:-1]]) / size

    signs = np.zeros(256, np.int64)
    signs[[b for b in range(0x21, 0x7F) if not chr(b).isalnum()]] = 1
    sign = signs[data]
    same = np.concatenate([[0], (data[1:] == data[:-1]) & (sign[1:] == 1)]).astype(np.int64)
    hashes = found.hashes()
    text = found.text_of()
    bucket = (hashes & np.uint64(BUCKETS - 1)).astype(np.int64)
    pairs = np.unique(text * BUCKETS + bucket)
    text_of, bucket_of = pairs // BUCKETS, pairs % BUCKETS
    counts = found.counts.astype(float)
    distinct = np.bincount(text_of, minlength=n) / np.maximum(counts, 1)
    shapes = np.stack(
        [
            share(_class_table("AZ")[data]),
            share(sign),
            share(_class_table("09")[data]),
            share(_class_table("||")[data]),
            share(same),
            share((data >= 0x80).astype(np.int64)),
            np.log1p(counts),
            distinct,
            size / np.maximum(counts, 1),
        ],
        axis=1,
    )
    return shapes, text_of, bucket_of


def _measured(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    for low, high, data, start in W.pieces(texts):
        # Capitals are a measure of their own; words are compared in lower case.
        yield low, high, *features(data, W.find_words(data, start, W.alphanumeric(), lower=True))


def fit(shapes: np.ndarray, text: np.ndarray, bucket: np.ndarray, label: np.ndarray) -> Classifier | None:
    """Ridge logistic regression by Newton steps; None if a class is missing."""
    n, ones = len(label), label.sum()
    if ones == 0 or ones == n:
        return None
    with_one = np.bincount(bucket, label[text], BUCKETS)
    with_any = np.bincount(bucket, minlength=BUCKETS).astype(float)
    rate = ones / n
    # How far a bucket's share of ones lies from the overall share, in standard errors.
    z = np.abs(with_one - with_any * rate) / np.sqrt(np.maximum(with_any, 1) * rate * (1 - rate) + 1)
    z[with_any < 4] = 0
    used = np.argsort(-z, kind="stable")[:USED_BUCKETS]
    used = used[z[used] > 4]
    place = np.full(BUCKETS, -1)
    place[used] = np.arange(len(used))
    mean, scale = shapes.mean(0), shapes.std(0) + 1e-9
    x = np.zeros((n, len(used) + SHAPES + 1))
    hit = place[bucket] >= 0
    x[text[hit], place[bucket[hit]]] = 1
    x[:, len(used) : -1] = np.clip((shapes - mean) / scale, -6, 6)
    x[:, -1] = 1
    ridge = np.full(x.shape[1], 0.1)
    ridge[-1] = 1e-3
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - label) + ridge * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    word = np.zeros(BUCKETS)
    word[used] = w[: len(used)]
    return Classifier(word, w[len(used) : -1], mean, scale, float(w[-1]))


def train(
    docs: DataFrame, labels: DataFrame, targets: tuple[str, ...], text: str, key: str, rows: int = TRAIN_ROWS
) -> dict[str, Classifier | None]:
    """One classifier per target column, fitted on at most ``rows`` labelled documents."""
    chosen = (
        labels.select(F.col(f"`{key}`").alias("key"), *[F.col(f"`{t}`").cast("double").alias(f"y{i}") for i, t in enumerate(targets)])
        .where(F.col("key").isNotNull())
        .orderBy(F.xxhash64("key"), "key", *[f"y{i}" for i in range(len(targets))])
        .limit(rows)
    )
    source = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    # At most ``rows`` small rows are broadcast.
    joined = source.join(F.broadcast(chosen), "key")
    # Rows may share a labelled id: each label learns from one of their texts, the least.
    joined = joined.groupBy("key", *[f"y{i}" for i in range(len(targets))]).agg(F.min("text").alias("text")).drop("key")
    joined = joined.select("text", *[f"y{i}" for i in range(len(targets))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, shapes, doc, bucket in _measured(batch.column(0)):
                first = np.searchsorted(doc, np.arange(high - low + 1))
                yield pa.RecordBatch.from_arrays(
                    [
                        *[batch.column(1 + i).slice(low, high - low) for i in range(len(targets))],
                        pa.array(list(shapes), pa.list_(pa.float64())),
                        pa.array([bucket[a:b].astype(np.int32) for a, b in zip(first, first[1:])], pa.list_(pa.int32())),
                    ],
                    names=[*[f"y{i}" for i in range(len(targets))], "shapes", "buckets"],
                )

    schema = ", ".join([*[f"y{i} double" for i in range(len(targets))], "shapes array<double>, buckets array<int>"])
    found = joined.mapInArrow(run, schema).toArrow()
    if not found.num_rows:
        return dict.fromkeys(targets)
    shapes = np.array(found.column("shapes").to_pylist(), float)
    buckets = [np.array(b, np.int64) for b in found.column("buckets").to_pylist()]
    out = {}
    for i, target in enumerate(targets):
        y = np.array([np.nan if v is None else v for v in found.column(f"y{i}").to_pylist()], float)
        known = np.flatnonzero(~np.isnan(y))
        if not len(known):
            out[target] = None
            continue
        # A fixed order, so that sums do not depend on the order of arrival.
        known = known[np.lexsort([shapes[known, j] for j in range(SHAPES)])]
        text_of = np.repeat(np.arange(len(known)), [len(buckets[k]) for k in known])
        flat = np.concatenate([buckets[k] for k in known])
        out[target] = fit(shapes[known], text_of, flat, (y[known] >= 0.5).astype(float))
    return out


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def _sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def _strength(children: DataFrame, rate: str, parent_rate: str, n: str) -> float:
    """How many documents a parent's rate is worth, by the method of moments.

    With the children's rates spread by v around their parents' beyond the binomial share,
    a beta prior has strength r (1 - r) / v - 1. Only one row of sums reaches the driver.
    """
    r, p, k = F.col(rate), F.col(parent_rate), F.col(n)
    row = children.agg(
        F.sum(k * (r - p) * (r - p)).alias("between"),
        F.sum(p * (1 - p)).alias("chance"),
        F.sum(k * p * (1 - p)).alias("total"),
        F.sum(k).alias("n"),
    ).first()
    if not row["n"] or not row["total"]:
        return STRONGEST
    excess = max(row["between"] - row["chance"], 0.0) / row["n"]
    if excess == 0:
        return STRONGEST
    return float(min(max(row["total"] / row["n"] / excess - 1, WEAKEST), STRONGEST))


def site_rates(scores: DataFrame, p: str) -> tuple[DataFrame, float, float]:
    """(host, path, n, s, host_rate) per path, the strength of hosts over paths, the global rate."""
    paths = scores.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(p).alias("s"))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("s").alias("host_s"))
    whole = hosts.agg(F.sum("host_s"), F.sum("host_n")).first()
    overall = whole[0] / whole[1] if whole[1] else 0.5
    rated = hosts.select("host", "host_n", (F.col("host_s") / F.col("host_n")).alias("raw"), F.lit(overall).alias("above"), "host_s")
    strong = _strength(rated, "raw", "above", "host_n")
    hosts = rated.select("host", ((F.col("host_s") + strong * overall) / (F.col("host_n") + strong)).alias("host_rate"))
    paths = paths.join(hosts, "host").withColumn("raw", F.col("s") / F.col("n"))
    return paths.drop("raw"), _strength(paths, "raw", "host_rate", "n"), overall


TARGETS = ("quality", "toxic")


def classify(
    docs: DataFrame,
    labels: DataFrame,
    host: Column,
    path: Column,
    text: str = "text",
    key: str = "doc_id",
    train_rows: int = TRAIN_ROWS,
) -> DataFrame:
    """One row per row of ``docs``: key, host, path, evidence, posteriors, kept.

    Columns: ``key``, host, path, quality_evidence, toxic_evidence (log-odds),
    quality, toxic (posterior probabilities), kept. Null hosts and paths form the site ''.
    Null and empty texts are scored by their (absent) words; repeated rows get equal rows;
    a label without both classes gives no evidence, and then no document is rejected for
    it; an empty table gives no rows. Columns of other names are not read.
    """
    spark = ready(docs.sparkSession)
    models = train(docs, labels, TARGETS, text, key, train_rows)
    weights = spark.sparkContext.broadcast(models)  # two tables of BUCKETS weights
    source = docs.select(
        F.col(f"`{key}`").alias("key"),
        F.coalesce(host.cast("string"), F.lit("")).alias("host"),
        F.coalesce(path.cast("string"), F.lit("")).alias("path"),
        F.col(f"`{text}`").cast("string").alias("text"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, shapes, doc, bucket in _measured(batch.column(3)):
                n = high - low
                scores = [
                    np.zeros(n) if weights.value[t] is None else weights.value[t].evidence(shapes, doc, bucket, n) for t in TARGETS
                ]
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(i).slice(low, n) for i in range(3)], *map(pa.array, scores)],
                    names=["key", "host", "path", "e0", "e1"],
                )

    kind = source.schema["key"].dataType.simpleString()
    scores = stored(
        source.mapInArrow(run, f"key {kind}, host string, path string, e0 double, e1 double")
        .withColumn("p0", _sigmoid(F.col("e0")))
        .withColumn("p1", _sigmoid(F.col("e1"))),
        "quality-scores",
    )
    out = scores
    for i, target in enumerate(TARGETS):
        paths, strong, overall = site_rates(scores, f"p{i}")
        # Written and read again, the sites have a known size: few are broadcast by Spark, many
        # are shuffled, and then a hot site's documents are dealt out by AQE's skew handling.
        paths = stored(paths, "quality-sites").withColumnsRenamed({"n": f"n{i}", "s": f"s{i}", "host_rate": f"r{i}"})
        out = out.join(paths, ["host", "path"])
        rest = F.greatest(F.col(f"s{i}") - F.col(f"p{i}"), F.lit(0.0))
        rate = (rest + strong * F.col(f"r{i}")) / (F.col(f"n{i}") - 1 + strong)
        evidence = F.col(f"e{i}") if models[target] is not None else F.lit(0.0)
        out = out.withColumn(target, _sigmoid(evidence + _logit(rate) - _logit(F.lit(float(overall)))))
    good = F.col("quality") >= 0.5 if models["quality"] is not None else F.lit(True)
    clean = F.col("toxic") < 0.5 if models["toxic"] is not None else F.lit(True)
    return out.select(
        F.col("key").alias(key),
        "host",
        "path",
        F.col("e0").alias("quality_evidence"),
        F.col("e1").alias("toxic_evidence"),
        "quality",
        "toxic",
        (good & clean).alias("kept"),
    )
