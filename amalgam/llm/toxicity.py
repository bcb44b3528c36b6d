"""Toxicity: cumulative-link (proportional-odds) ordinal regression over sparse text features.

Severity grades are 0 (not toxic) to 3. Labels only say toxic or not, so the training grade of a toxic document is derived
from how often it uses terms that mark toxic documents: fewer than 3 times is grade 1, fewer than 6 grade 2, else 3. One
weight vector is shared by all grades: P(grade >= k) = sigmoid(w.x - threshold_k) with ordered thresholds. The severity
of a document is its expected grade; a document is toxic where P(grade >= 1) is at least 0.5.

Features are hashed words and word beginnings of 4 to 7 letters of the whole text, counted as log(1 + n). Words joined by
other characters count each and, for words that are spelled out, glued together. Scripts without spaces have features at
every letter: two letters as a word, and the beginnings from there. The fit keeps
the 512 that tell toxic from other documents best (chi-square; ties by feature number). It uses a bounded sample of labelled
rows (by hash of doc_id, at most ``TOXIC`` toxic and ``CLEAN`` other ones), never those with crc32(doc_id as text) mod 5 = 0.
Features of the sample are counted in Spark; only the kept ones and the sample's counts of these leave the executors, so
the driver's share does not grow with the texts.

Null and empty texts have no feature; very long texts are read whole and counted without a cap, in fit and score alike.
Every row gets its own text's result, so rows that repeat a doc_id or have none need no care; a fit takes one of the rows
that repeat a doc_id, by a hash of the text. Further columns, whatever their names, are not read, and kept by :func:`without_toxic`.
Labels with null doc_id or toxic are not used; a doc_id labelled twice counts as toxic if one label says so. Where no toxic
or no clean label is left, nothing is toxic and every severity is 0. An empty table gives no row.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from amalgam.llm.bpe import Remembering
from amalgam.llm.common import dropped, saved, table

TOXIC, CLEAN, KEPT, GRADES, SURE = 1500, 3000, 512, 3, 0.5
#: Files that the sample is kept in, and so tasks that read it.
FILES = 16
BEGINNINGS = (4, 5, 6, 7)
KINDS = 1 + len(BEGINNINGS)
NOT_LETTERS = re.compile(r"[\W\d_]+")
#: Thai, Lao, Tibetan, Burmese, Khmer, kana and Chinese characters, whose words no space parts.
UNSPACED = re.compile(r"[\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]{2,}")


def hashed(parts: list[str]) -> list[int]:
    """Features of a word and its beginnings. The feature modulo KINDS tells which."""
    return [crc32(p.encode()) * KINDS + k for k, p in enumerate(parts)]


def word_features(word: str) -> list[int]:
    return hashed([word, *(word[:n] for n in BEGINNINGS if len(word) >= n)]) if len(word) >= 3 else []


def term_features(token: str) -> tuple[int, ...]:
    """Hashed features of a token: of each word in it, and those that only all its letters together have."""
    token = token.lower()
    words = [w for w in NOT_LETTERS.split(token) if w]
    glued = word_features("".join(words))
    own = [f for w in words for f in word_features(w)] if len(words) > 1 else []
    if not token.isascii():
        for run in UNSPACED.findall(token):
            for i in range(len(run) - 1):
                own += hashed([run[i : i + 2], *(run[i : i + n] for n in BEGINNINGS if len(run) - i >= n)])
    if not own:
        return tuple(glued)
    known = set(own)
    return (*own, *(f for f in glued if f not in known))


@dataclass
class Model:
    features: dict[int, int]  # feature -> column
    weights: np.ndarray
    thresholds: np.ndarray

    def at_least(self, x: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1 .. GRADES of each row of x."""
        return 1 / (1 + np.exp(-np.clip((x @ self.weights)[:, None] - self.thresholds[None, :], -60, 60)))


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A bounded sample of training rows (doc_id, text, toxic)."""
    known = labels.filter("doc_id is not null and toxic is not null and pmod(crc32(cast(doc_id as string)), 5) <> 0")
    known = known.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max(F.col("toxic").cast("int")).alias("_toxic"))
    here = known.join(docs.select(F.col("doc_id").alias("_id")), "_id", "left_semi")  # labels of documents that are not here do not take places
    order = F.xxhash64("_id"), F.col("_id")
    chosen = here.filter("_toxic > 0").orderBy(*order).limit(TOXIC).union(here.filter("_toxic = 0").orderBy(*order).limit(CLEAN))
    # at most TOXIC + CLEAN rows of two numbers
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), "text").join(F.broadcast(chosen), "_id")
    return rows.groupBy("_id", F.col("_toxic").alias("toxic")).agg(F.min_by("text", F.xxhash64("text")).alias("text"))


def counted(text: str | None, terms: Remembering) -> Counter:
    """How often each feature occurs in a text."""
    found: Counter = Counter()
    for token, n in Counter((text or "").split()).items():
        for f in terms[token]:
            found[f] += n
    return found


def marking_features(sample: DataFrame, n_toxic: int, n_clean: int) -> list:
    """(feature, toxic, clean): the best features by chi-square with the number of sampled documents of each kind that hold them.

    Only features that occur relatively more often in toxic documents, and in two at least, are taken.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Remembering(term_features, 200_000)
        for batch in batches:
            for part in (batch.slice(i, 100) for i in range(0, batch.num_rows, 100)):
                seen: tuple[Counter, Counter] = Counter(), Counter()
                for text, toxic in zip(part.column(1), part.column(2), strict=True):
                    seen[toxic.as_py() > 0].update(counted(text.as_py(), terms).keys())
                features = sorted(seen[0].keys() | seen[1].keys())
                columns = [features, [seen[1][f] for f in features], [seen[0][f] for f in features]]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["feature", "toxic", "clean"])

    each = sample.mapInArrow(run, "feature long, toxic long, clean long").groupBy("feature").agg(*[F.sum(c).cast("double").alias(c) for c in ("toxic", "clean")])
    t, c, n = F.col("toxic"), F.col("clean"), n_toxic + n_clean
    seen, lead = t + c, t * n_clean - c * n_toxic
    each = each.filter((lead > 0) & (t >= 2)).withColumn("chi", lead * lead * n / (seen * F.greatest(F.lit(n) - seen, F.lit(1)) * float(n_toxic) * n_clean))
    return each.orderBy(F.desc("chi"), "feature").limit(KEPT).collect()


def sample_counts(sample: DataFrame, column: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the kept features (rows by id) and the labels; at most TOXIC + CLEAN times KEPT numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Remembering(lambda token: tuple(f for f in term_features(token) if f in column), 200_000)
        for batch in batches:
            for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                found = [sorted((column[f], n) for f, n in counted(t.as_py(), terms).items()) for t in part.column(1)]
                columns = [pa.array([[x[k] for x in d] for d in found], pa.list_(kind)) for k, kind in ((0, pa.int32()), (1, pa.int64()))]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns, part.column(2)], names=["id", "columns", "counts", "toxic"])

    got = sample.mapInArrow(run, "id long, columns array<int>, counts array<long>, toxic int").toArrow().sort_by("id")
    x = np.zeros((got.num_rows, len(column)))
    for row, at, n in zip(x, got["columns"].to_pylist(), got["counts"].to_pylist(), strict=True):
        row[at] = n
    return x, got["toxic"].to_numpy()


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    sample = saved(labelled(docs, labels).select("_id", "text", "toxic").repartition(FILES), "toxic-sample")
    n_toxic, n_clean = (n or 0 for n in sample.agg(F.count_if(F.col("toxic") > 0), F.count_if(F.col("toxic") <= 0)).first())
    best = marking_features(sample, n_toxic, n_clean) if n_toxic and n_clean else []
    if not best:
        return None
    x, toxic = sample_counts(sample, {r.feature: i for i, r in enumerate(best)})
    dropped(sample)
    is_toxic = toxic > 0
    # how often a document uses marking terms: the most of any kind, so that a word and its beginnings count once
    sure, kind = np.array([r.toxic / (r.toxic + r.clean) >= 0.8 for r in best]), np.array([r.feature % KINDS for r in best])
    hits = np.max([x[:, sure & (kind == k)].sum(axis=1) for k in range(KINDS)], axis=0)
    grade = np.where(is_toxic, np.select([hits < 3, hits < 6], [1, 2], 3), 0)
    weights, thresholds = proportional_odds(np.log1p(x), grade)
    return Model({r.feature: i for i, r in enumerate(best)}, weights, thresholds)


def proportional_odds(x: np.ndarray, grade: np.ndarray, rounds: int = 400, rate: float = 0.05, penalty: float = 2e-3) -> tuple[np.ndarray, np.ndarray]:
    """Fit shared weights and ordered thresholds (the first one, then logarithms of the steps) by Adam."""
    n, d = x.shape
    x = x.astype(np.float32)
    p = np.concatenate([np.zeros(d), [2.0], np.zeros(GRADES - 1)])
    m, v = np.zeros_like(p), np.zeros_like(p)
    row = np.arange(n)
    for step in range(1, rounds + 1):
        w, steps = p[:d], np.exp(p[d + 1 :])
        thresholds = p[d] + np.r_[0, np.cumsum(steps)]
        reach = 1 / (1 + np.exp(-np.clip((x @ w.astype(np.float32)).astype(np.float64)[:, None] - thresholds, -60, 60)))
        edge = np.hstack([np.ones((n, 1)), reach, np.zeros((n, 1))])
        slope = edge * (1 - edge)
        upper, lower = edge[row, grade], edge[row, grade + 1]
        chance = np.maximum(upper - lower, 1e-12)
        up, down = slope[row, grade] / chance, slope[row, grade + 1] / chance
        d_score = -(up - down) / n
        d_threshold = np.zeros(GRADES)
        np.add.at(d_threshold, np.clip(grade - 1, 0, None), np.where(grade > 0, up, 0) / n)
        np.add.at(d_threshold, np.clip(grade, None, GRADES - 1), np.where(grade < GRADES, -down, 0) / n)
        after = np.cumsum(d_threshold[::-1])[::-1]
        g = np.concatenate([x.T @ d_score.astype(np.float32) + penalty * w / 10, [after[0]], after[1:] * steps])
        g[d + 1 :] += penalty * p[d + 1 :]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return p[:d], p[d] + np.r_[0, np.cumsum(np.exp(p[d + 1 :]))]


def scored(docs: DataFrame, model: Model | None, keep: bool = False) -> DataFrame:
    """(doc_id, severity, grade, toxic); with ``keep`` all columns of the documents that are not toxic instead."""

    def values(texts: list[str | None], terms: Remembering) -> tuple[np.ndarray, np.ndarray]:
        if model is None:
            return np.zeros(len(texts)), np.zeros(len(texts), bool)
        x = np.zeros((len(texts), len(model.weights)))
        for i, text in enumerate(texts):
            for token, n in Counter((text or "").split()).items():
                for c in terms[token]:
                    x[i, c] += n
        reach = model.at_least(np.log1p(x))
        return reach.sum(axis=1), reach[:, 0] >= SURE

    def columns_of(token: str) -> tuple[int, ...]:
        return tuple(model.features[f] for f in term_features(token) if f in model.features)

    at = docs.columns.index("text") if keep else 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Remembering(columns_of, 200_000)
        for batch in batches:
            for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                severity, toxic = values(part.column(at).to_pylist(), terms)
                if keep:
                    yield part.filter(pa.array(~toxic))
                else:
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(severity), pa.array(np.rint(severity).astype(np.int32)), pa.array(toxic.astype(np.int32))], names=["doc_id", "severity", "grade", "toxic"])

    if keep:
        return docs.mapInArrow(run, docs.schema)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, severity double, grade int, toxic int")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, fit(docs, table(spark, sf_dir, "labels")))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return scored(docs, fit(docs, labels), keep=True)
