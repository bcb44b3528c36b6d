import numpy as np
import pytest
from pyspark.sql import functions as F

from amalgam.llm import embed


def brute(rows, threshold=0.98):
    """rows: (vec_id, embedding, label) -> {vec_id: (n_links, component_id, kept)} for distinct vec_ids."""
    def good(v):
        return v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v) and np.linalg.norm(v) > 0

    n = len(rows)
    links = [[] for _ in rows]
    for i in range(n):
        for j in range(i):
            (_, a, la), (_, b, lb) = rows[i], rows[j]
            if la is not None and la == lb and good(a) and good(b) and len(a) == len(b):
                a, b = np.array(a, float), np.array(b, float)
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= threshold:
                    links[i].append(j)
                    links[j].append(i)
    part = list(range(n))
    changed = True
    while changed:
        changed = False
        for i in range(n):
            low = min([part[i], *(part[j] for j in links[i])])
            changed, part[i] = changed or low != part[i], low
    least = {}
    for i, (v, _, _) in enumerate(rows):
        least[part[i]] = min(least.get(part[i], v), v)
    return {v: (len(links[i]), least[part[i]], v == least[part[i]]) for i, (v, _, _) in enumerate(rows)}


def result(df):
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in df.collect()}


def clusters(seed, groups=12, size=9, dim=16):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(groups):
        c = rng.standard_normal(dim)
        for _ in range(size):
            rows.append((len(rows) * 3 % 1009, [float(x) for x in np.float32(c + rng.standard_normal(dim) * 0.12)], int(rng.integers(0, 2))))
    return rows


def test_clusters_equal_brute_force(spark):
    rows = clusters(1)
    want = brute(rows)
    assert sum(v[0] for v in want.values()) > 20
    assert result(embed.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))) == want


def test_salted_buckets_equal_brute_force(spark):
    rows = clusters(2)
    got = embed.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), block=2)
    assert result(got) == brute(rows)


def test_table_equals_brute_force(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    assert result(embed.op1_embedding_near_dedup(spark, sf_dir)) == brute(rows)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 0), (2, [], 0), (3, [0.0, 0.0], 0), (4, [nan, 1.0], 0), (5, [inf, 1.0], 0), (6, [None, 1.0], 0), (7, [1.0, 2.0], 0), (8, [1.0, 2.0], 0), (9, [2.0, 4.0], None),
            (10, [1.0, 2.0], 1), (11, [1.0, 2.0, 0.0], 0), (12, [2.0, 4.0], None), (13, [3.0, 6.0], 0)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, row string, code int")
    got = result(embed.near_duplicates(df))
    assert got == brute(rows)
    assert got[7] == (2, 7, True) and got[13] == (2, 7, False)


def test_empty_table(spark):
    assert embed.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []


VECTORS = "vec_id long, embedding array<float>, label int"


def test_repeated_and_null_ids(spark):
    a, b, c = [1.0, 2.0, 3.0], [1.0, 2.0, 3.01], [3.0, -1.0, 0.0]
    rows = [(5, a, 0), (5, a, 0), (None, a, 0), (7, b, 0), (None, c, 0), (None, c, 0), (9, c, 0), (None, None, 0), (11, [3.0, 3.0, 1.0], 0), (12, a, 1)]
    got = sorted(map(tuple, embed.near_duplicates(spark.createDataFrame(rows, VECTORS)).collect()), key=str)
    want = [(5, 3, 5, True), (5, 3, 5, True), (None, 3, 5, False), (7, 3, 5, False), (None, 2, 9, False), (None, 2, 9, False), (9, 2, 9, True), (None, 0, None, False), (11, 0, 11, True), (12, 0, 12, True)]
    assert got == sorted(want, key=str)


def test_double_vectors_of_great_and_tiny_size(spark):
    rows = [(1, [1e300, 2e300], 0), (2, [1e-300, 2e-300], 0), (3, [-1.0, -2.0], 0), (4, [-0.0, 1.0], 0), (5, [0.0, 1.0], 0)]
    got = result(embed.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")))
    assert got == {1: (1, 1, True), 2: (1, 1, False), 3: (0, 3, True), 4: (1, 4, True), 5: (1, 4, False)}


def test_vectors_of_whole_numbers(spark):
    rows = [(1, [3, 4], 0), (2, [6, 8], 0), (3, [4, 3], 0), (4, [None, 1], 0)]
    got = result(embed.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<int>, label int")))
    assert got == {1: (1, 1, True), 2: (1, 1, False), 3: (0, 3, True), 4: (0, 4, True)}


def test_one_large_group_of_near_copies_in_parts(spark):
    rng = np.random.default_rng(5)
    c = rng.standard_normal(16)
    rows = [(i, [float(x) for x in np.float32(c + rng.standard_normal(16) * 0.09)], 0) for i in range(300)]
    df = spark.createDataFrame(rows, VECTORS)
    assert result(embed.near_duplicates(df, block=64)) == result(embed.near_duplicates(df)) == brute(rows)


def test_copies_are_compared_once(spark):
    """N copies are one class: no vector leaves the scan for them, whatever N is."""
    v = [0.5, -1.0, 2.0]
    s = embed.scheme(1)
    for n in (2000, 4000):
        df = spark.createDataFrame([(i, v, 3) for i in range(n)], VECTORS).coalesce(1)
        sent = embed.placed(df.select("vec_id", F.col("label").cast("long"), "embedding"), s)
        assert sent.count() == s.tables
        rows = embed.near_duplicates(df).collect()
        assert {(r.n_links, r.component_id) for r in rows} == {(n - 1, 0)} and sum(r.kept for r in rows) == 1


def test_scheme_keeps_the_miss_at_the_threshold():
    agree = 1 - np.arccos(0.98) / np.pi
    for n in (0, 1, 1000, 10**6, 10**9, 10**12):
        s = embed.scheme(n)
        assert (1 - agree**s.signs) ** s.tables <= embed.MISS * 1.01 and 1 <= s.tables <= embed.MOST_TABLES
        assert n < 1000 or 2 <= n / 2**s.signs <= 8


def test_shared_folder_is_asked_for_on_a_cluster():
    from types import SimpleNamespace

    from amalgam.llm.common import shared_dir

    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(SimpleNamespace(conf={}, sparkContext=context))
