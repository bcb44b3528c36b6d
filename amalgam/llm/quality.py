"""Quality classifier: histogram gradient-boosted trees over document statistics.

Trees are complete binary trees of fixed depth, stored as flat arrays of split feature and threshold; scoring walks all
documents of a batch down one level of a tree at a time in numpy. The statistics describe the whole text only (never
label, language, source or doc_id). The fit uses at most ``SAMPLE`` labelled rows, chosen by hash of doc_id among those
with crc32(doc_id as text) mod 5 <> 0.

Null and empty texts have all statistics 0 and get the score that the trees give those; very long texts are read whole. Every
row gets its own text's result, so rows that repeat a doc_id or have none need no care; a fit takes one of the rows that
repeat a doc_id, by a hash of the text. Splits of equal gain (ties) go to the first statistic and the lowest cut. Further
columns, whatever their names, are not read, and kept by :func:`good`. Labels with null doc_id or quality are not used; a
doc_id labelled twice counts as good only if all labels say so. Without any label every score is 0.5. An empty table gives
no row.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from amalgam.llm.common import table

SAMPLE, BINS, TREES, DEPTH, RATE, SURE = 12_000, 64, 80, 4, 0.15, 0.3

CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "space": b" \t", "line": b"\n", "stop": b".", "comma": b",",
    "loud": b"!?", "bar": b"|", "odd": b"*%&$#@^~", "mark": b"<>{}[]=_\\/+", "quote": b"'\"()-:;", "wide": bytes(range(128, 256)),
}
BYTES = np.zeros((256, len(CLASSES)))
for _k, _members in enumerate(CLASSES.values()):
    BYTES[list(_members), _k] = 1
N_STATISTICS = len(CLASSES) + 16


def statistics(text: str | None) -> np.ndarray:
    out = np.zeros(N_STATISTICS)
    if not text:
        return out
    counts = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
    words, lines = text.split(), text.split("\n")
    seen = Counter(words)
    n, k = len(words), len(CLASSES)
    size = counts.sum()
    out[:k] = counts @ BYTES / size
    share = counts[counts > 0] / size
    full = [x for x in lines if x]
    out[k:] = (
        np.log1p(len(text)), np.log1p(n), len(text) / (n + 1), len(seen) / (n + 1), max(seen.values(), default=0) / (n + 1), sum(map(eq, words, words[1:])) / (n + 1),
        sum(map(str.isupper, words)) / (n + 1), sum(map(str.istitle, words)) / (n + 1), sum(map(str.isalpha, words)) / (n + 1), np.log1p(len(full)), len(set(full)) / (len(full) + 1),
        sum(map(str.isupper, full)) / (len(full) + 1), sum(" | " in x for x in full) / (len(full) + 1), -(share * np.log2(share)).sum(), max(map(len, words), default=0), np.log1p(max(map(len, lines))),
    )
    return out


@dataclass
class Forest:
    """Flat trees: node i has children 2i + 1 and 2i + 2; values are those of the lowest level."""

    base: float
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    value: np.ndarray  # trees x leaves

    def score(self, x: np.ndarray) -> np.ndarray:
        total, row = np.full(len(x), self.base), np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[row, feature[node]] > threshold[node])
            total += value[node - len(feature)]
        return 1 / (1 + np.exp(-total))


def boosted(x: np.ndarray, y: np.ndarray, least: float = 8.0, penalty: float = 2.0) -> Forest:
    """Fit by second-order boosting of the logistic loss over histograms of BINS quantile bins."""
    n, d = x.shape
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    rate = np.clip(y.mean(), 0.01, 0.99)
    forest = Forest(float(np.log(rate / (1 - rate))), np.zeros((TREES, inner), np.int64), np.full((TREES, inner), np.inf), np.zeros((TREES, leaves)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(d)]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)  # bin b holds cuts[b-1] < x <= cuts[b]
    total = np.full(n, forest.base)
    for t in range(TREES):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(DEPTH):
            first, width = 2**level - 1, 2**level
            at = node - first
            best = np.full(width, 1e-6)
            for j in range(d):
                where = at * BINS + binned[:, j]
                gs, hs = (np.bincount(where, s, width * BINS).reshape(width, BINS).cumsum(axis=1) for s in (g, h))
                all_g, all_h = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + penalty) + (all_g - gs) ** 2 / (all_h - hs + penalty) - all_g**2 / (all_h + penalty)
                gain[(hs < least / 10) | (all_h - hs < least / 10)] = 0
                gain = gain[:, : len(cuts[j])]
                if not gain.shape[1]:
                    continue
                k = gain.argmax(axis=1)
                top = gain[np.arange(width), k]
                for i in np.flatnonzero(top > best):
                    best[i], forest.feature[t, first + i], forest.threshold[t, first + i] = top[i], j, cuts[j][k[i]]
            node = 2 * node + 1 + (x[np.arange(n), forest.feature[t, node]] > forest.threshold[t, node])
        leaf = node - inner
        forest.value[t] = RATE * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + penalty)
        total += forest.value[t][leaf]
    return forest


def fit(docs: DataFrame, labels: DataFrame) -> Forest | None:
    known = labels.filter("doc_id is not null and quality is not null and pmod(crc32(cast(doc_id as string)), 5) <> 0")
    known = known.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.min(F.col("quality").cast("int")).alias("_quality"))
    here = known.join(docs.select(F.col("doc_id").alias("_id")), "_id", "left_semi")  # labels of documents that are not here do not take places
    chosen = here.orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [statistics(t.as_py()).tobytes() for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(x, pa.binary()), batch.column(2)], names=["id", "x", "y"])

    # at most SAMPLE rows of two numbers are broadcast, and of N_STATISTICS numbers collected
    sample = docs.select(F.col("doc_id").cast("long").alias("_id"), "text").join(F.broadcast(chosen), "_id")
    sample = sample.groupBy("_id", "_quality").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("text", "_id", "_quality")
    got = sample.mapInArrow(run, "id long, x binary, y int").toArrow().sort_by("id")
    if not got.num_rows:
        return None
    x = np.frombuffer(b"".join(got["x"].to_pylist())).reshape(-1, N_STATISTICS)
    return boosted(x, (got["y"].to_numpy() > 0).astype(np.float64))


def scored(docs: DataFrame, forest: Forest | None, keep: bool = False) -> DataFrame:
    """(doc_id, held_out, score, predicted); with ``keep`` all columns of the documents predicted good instead."""
    at = docs.columns.index("text") if keep else 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 1000) for i in range(0, batch.num_rows, 1000)):
                x = np.stack([statistics(t.as_py()) for t in part.column(at)])
                score = forest.score(x) if forest else np.full(len(x), 0.5)
                if keep:
                    yield part.filter(pa.array(score >= SURE))
                else:
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score)], names=["doc_id", "score"])

    if keep:
        return docs.mapInArrow(run, docs.schema)
    out = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")
    held_out = F.coalesce(F.expr("pmod(crc32(cast(doc_id as string)), 5) = 0"), F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= SURE, 1).otherwise(0).alias("predicted"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, fit(docs, table(spark, sf_dir, "labels")))


def good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return scored(docs, fit(docs, labels), keep=True)
