import hashlib
import random
import zlib

import numpy as np
import pytest

from amalgam.llm import periodic


def plain_runs(ids, shortest=24, exponent=3):
    """By the definition: every maximal stretch of period q, kept if no smaller period holds for it."""
    found, n = [], len(ids)
    for q in range(1, n // exponent + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and ids[j] == ids[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(shortest, exponent * q):
                stretch = ids[i : i + size]
                if not any(all(stretch[k] == stretch[k + p] for k in range(size - p)) for p in range(1, q)):
                    found.append((i, size, q))
            i = max(j, i) + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text, plant=True):
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text or "").split(" ") if w]
    n = len(words)
    if plant and doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    dropped = {i for s, size, q in runs for i in range(s + q, s + size)}
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    own = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *own, sha("".join(f"{s},{size},{q}\n" for s, size, q in runs)), sha(kept))


def repeating(rnd, n):
    """Texts of few words with blocks that repeat, blocks within blocks too."""
    words = [rnd.choice("abc") for _ in range(n)]
    for _ in range(rnd.randrange(4) if n else 0):
        q, at = rnd.randrange(1, max(2, n // 4)), rnd.randrange(n)
        block = [rnd.choice("abcd") for _ in range(q)]
        if rnd.random() < 0.4:
            block *= rnd.randrange(2, 5)
        stretch = (block * n)[: rnd.randrange(n)]
        words[at : at + len(stretch)] = stretch
    return words[:n]


def test_runs_by_the_definition():
    rnd = random.Random(3)
    for k in range(250):
        ids = periodic.word_ids([w.encode() for w in repeating(rnd, rnd.choice([0, 1, 23, 24, 25, 60, 120, 200]) + rnd.randrange(3))])
        want = plain_runs(ids.tolist())
        assert sorted(periodic.runs_at(ids, 1, len(ids)), key=lambda r: (r[0], r[2])) == want, (k, ids.tolist())
        work = rnd.choice([60, 500, 1500])
        ranges = periodic.lag_ranges(len(ids), work)
        assert ranges[0][0] == 1 and ranges[-1][1] == len(ids) // 3 + 1 and all(a[1] == b[0] for a, b in zip(ranges, ranges[1:]))
        first = periodic.runs_at(ids, *ranges[0])
        assert sorted(first + [r for a, b in ranges[1:] for r in periodic.runs_at(ids, a, b, first)], key=lambda r: (r[0], r[2])) == want


def test_runs_in_long_texts():
    """Lags in many octaves and more lags than are scanned at once; runs at every place."""
    rnd = random.Random(9)
    for n, q in ((4000, 1), (4000, 7), (4000, 8), (4000, 15), (4000, 16), (4000, 17), (4000, 130), (4000, 511), (4000, 1333), (9000, 2999)):
        size = max(24, 3 * q)
        at = rnd.randrange(n - size + 1)
        ids = np.arange(10, 10 + n, dtype=np.int32)
        ids[at : at + size] = np.tile(ids[at : at + q], -(-size // q))[:size]
        assert periodic.runs_at(ids, 1, n) == [(at, size, q)]
        assert periodic.runs_at(ids[: at + size - 1], 1, n) == []
    same = np.zeros(30_000, np.int32)
    assert periodic.runs_at(same, 1, 30_000) == [(0, 30_000, 1)]
    assert periodic.runs_at(np.tile(np.arange(6, dtype=np.int32), 4000), 1, 24_000) == [(0, 24_000, 6)]


@pytest.mark.parametrize("work", [periodic.WORK, 3000])
def test_documents(spark, sf_dir, work):
    """All rows of the query by the definition, dealt out by lag ranges too."""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect() if len(r.text or "") < 6000]
    known = {d for d, _ in docs}
    rows = periodic.op13_periodic_runs(spark, sf_dir) if work == periodic.WORK else periodic.periodic_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"), periodic.planted, work)
    assert sorted(tuple(r) for r in rows.collect() if r.doc_id in known) == sorted(plain_row(*d) for d in docs)
    assert sum(plain_row(*d)[1] for d in docs) > 5


def test_edges(spark, documents, edge_texts):
    loop = "one two three " * 20
    texts = [*edge_texts, "a " * 24, "a " * 23, loop, loop + "four " + loop, "x\x1fy\x85z " * 30, f"\x0b{loop}\x0c"]
    texts = [t if t is None or len(t) < 200_000 else t[:40_000] for t in texts]
    for ids in (list(range(len(texts))), [None] * len(texts)):
        for work in (periodic.WORK, 64):
            got = periodic.periodic_runs(documents(texts, ids=ids).repartition(3), periodic.planted, work).collect()
            want = [row(i, t) for i, t in zip(ids, texts)]
            assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert periodic.periodic_runs(documents([])).collect() == []
    twice = periodic.periodic_runs(documents([loop, loop], ids=[4, 4])).collect()
    assert twice[0] == twice[1] and twice[0].n_runs == 1 and twice[0].exponent_milli == 20_000


def row(doc_id, text):
    words = (text or "").split(" ")
    if len(words) > 5000 and len(set(words)) <= 2:  # the definition takes too long here
        words = [w for w in words if w]
        h = zlib.crc32(str(doc_id).encode())
        assert len(set(words)) == 1
        runs = f"0,{len(words)},1\n"
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        return (doc_id, 1, 0, len(words), 1, 1000 * len(words), sha(runs), sha(words[0]))
    return plain_row(doc_id, text)


def test_only_long_documents_are_shuffled(spark, documents):
    plan = periodic.periodic_runs(documents(["a b"]))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
