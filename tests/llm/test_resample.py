import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from amalgam.llm import resample


def plain(docs, target, lo=1, hi=1, buckets=10_000, seed=2024, least=20, percent=10):
    """Every row as the rule says, by one sort: (doc_id, n_features, weight, score, rank)."""

    def words(text):
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)

    def features(text):
        w = words(text)
        return [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(lo, hi + 1) for i in range(len(w) - k + 1)]

    own, aim = Counter(), Counter()
    for _, text in docs:
        own.update(features(text))
    for text in target:
        aim.update(features(text))
    s_all, t_all = float(own.total()), float(aim.total())
    gain = [math.floor(1000 * math.log((aim[b] + 1) * (s_all + buckets) / ((own[b] + 1) * (t_all + buckets)))) for b in range(buckets)]
    rows = []
    for doc_id, text in docs:
        f = features(text)
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append((doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(text)) >= least))
    rows.sort(key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1]))
    draws, rank, out = sum(r[4] for r in rows) * percent // 100, 0, []
    for r in rows:
        rank += r[4]
        out.append((*r[:4], rank if r[4] and rank <= draws else None))
    return out


def same(got, want):
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, want))


@pytest.fixture(scope="module")
def target(spark):
    return spark.createDataFrame([("a lake and a river by the sea", 1), (None, 2), ("", 3), ("the Sea", 4)], "text string, n_features int")


def corpus(n):
    rnd = random.Random(5)
    texts = [" ".join(rnd.choices(["the", "Sea", "lake", "tax", "form", "día", "x9", "river,", "-", "日本"], k=rnd.choice([0, 5, 19, 20, 21, 60]))) for _ in range(n)]
    return texts


def test_all_rows_by_brute_force(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = plain(docs, [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()])
    got = resample.op11_importance_resampling(spark, sf_dir).collect()
    same(got, want)
    ranks = sorted(r.rank for r in got if r.rank)
    assert ranks == list(range(1, len(ranks) + 1)) and len(ranks) > 10


@pytest.mark.parametrize("drawing", [{}, {"range_rows": 25, "block_rows": 3}, {"range_rows": 100, "block_rows": 1}, {"percent": 100, "range_rows": 40, "block_rows": 8}, {"percent": 0}])
def test_ranges_and_blocks_change_nothing(spark, documents, target, drawing):
    """Repeated rows, rows without id and ties of whole rows, in many runs."""
    texts = corpus(600)
    ids = [None] * 60 + [7] * 60 + list(range(100, 580))
    texts[:40], texts[60:100] = [texts[3]] * 40, [texts[70]] * 40
    docs = documents(texts, ids=ids).repartition(9)
    want = plain(list(zip(ids, texts)), [r.text for r in target.collect()], percent=drawing.get("percent", 10))
    same(resample.resampled(docs, target, **drawing).collect(), want)


def test_longer_features(documents, target):
    texts = corpus(120)
    want = plain(list(enumerate(texts)), [r.text for r in target.collect()], lo=1, hi=2, buckets=97, seed=3, least=6)
    same(resample.resampled(documents(texts), target, runs=(1, 2), buckets=97, seed=3, least_words=6).collect(), want)
    want = plain(list(enumerate(texts)), [r.text for r in target.collect()], lo=2, hi=3)
    same(resample.resampled(documents(texts), target, runs=(2, 3)).collect(), want)


def test_edges(documents, target, edge_texts):
    ids = [None, None, *range(len(edge_texts) - 2)]
    same(resample.resampled(documents(edge_texts, ids=ids), target).collect(), plain(list(zip(ids, edge_texts)), [r.text for r in target.collect()]))
    assert resample.resampled(documents([]), target).collect() == []
    texts = corpus(50)
    same(resample.resampled(documents(texts), target.limit(0)).collect(), plain(list(enumerate(texts)), []))


def test_the_merge_holds_one_block_of_a_run():
    rnd = random.Random(1)
    runs = [sorted(((rnd.randrange(10_000), r, i), (r,)) for i in range(300)) for r in range(13)]
    blocks = sorted((run[i : i + 10] for run in runs for i in range(0, 300, 10)), key=lambda b: b[0][0])
    merge = resample.Merge((b[0], iter(b)) for b in blocks)
    got = []
    for row in merge:
        got.append(row)
        assert merge.tree.size <= 16
        if len(got) == 1000:
            break
    assert got == sorted(x for run in runs for x in run)[:1000]
    assert sorted([*got, *merge.rest()]) == sorted(x for run in runs for x in run)
