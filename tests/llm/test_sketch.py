import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from amalgam.llm import sketch
from amalgam.llm.common import block_of


def multiset_likeness(a, b):
    a, b = sorted(sketch.paragraphs(a)), sorted(sketch.paragraphs(b))
    common = sum(min(a.count(p), b.count(p)) for p in set(a))
    union = len(a) + len(b) - common
    return common / union if union else 1.0


def check(rows, docs):
    """docs: (doc_id, text) in order."""
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(docs) == len(got)
    for i, (d, t) in enumerate(docs):
        t, n = t or "", docs[(i + 1) % len(docs)][1] or ""
        q = len(t) // 4
        e = t[: len(t) - q] + n[:q]
        r = got[d]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        assert abs(r.near_edited - multiset_likeness(t, e)) < 1e-12 and abs(r.near_next - multiset_likeness(t, n)) < 1e-12
        assert [r.fingerprint, r.edited_fingerprint] == sketch.fingerprints([sketch.digests(t), sketch.digests(e)])


def test_documents_equal_brute_force(spark, sf_dir):
    docs = sorted((d.doc_id, d.text) for d in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    check(sketch.op2_document_fingerprints(spark, sf_dir).collect(), docs)


def test_edges(documents, edge_texts):
    texts = edge_texts + edge_texts[:2]
    check(sketch.version_fingerprints(documents(texts)).collect(), list(enumerate(texts)))


def test_one_document_follows_itself(documents):
    (r,) = sketch.version_fingerprints(documents(["A b. C d. E f."])).collect()
    assert r.near_next == 1.0


def test_repeated_and_null_ids_keep_all_rows(documents):
    docs = documents(["b", "a", "c", "a", None], ids=[7, 7, None, 7, None])
    rows = sketch.version_fingerprints(docs).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.n_chars) for r in rows) == [(False, 7, 1)] * 3 + [(True, None, 0), (True, None, 1)]


def test_hot_ids_are_cut_by_their_texts(documents):
    """Null and repeated ids that fill most of the table: several blocks each, and still the order of (doc_id, text)."""
    texts = [f"{chr(97 + i % 26)} text number {i}. It goes on here." for i in range(900)]
    ids = [None if i % 3 == 0 else 50 if i % 3 == 1 else 1000 + i if i % 2 else i // 20 for i in range(900)]
    docs = documents(texts, ids=ids)
    dealt = sketch.in_id_order(docs, True, blocks=24)
    sizes = [r["count"] for r in dealt.filter("guest = 0").groupBy("block").count().collect()]
    assert sum(sizes) == 900 and max(sizes) < 150 and dealt.filter("guest = 1").count() < 3 * len(sizes)
    order = sorted(zip(ids, texts), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    rows = sketch.version_fingerprints(docs, blocks=24).collect()
    want = []
    for i, (d, t) in enumerate(order):
        n, q = order[(i + 1) % 900][1], len(t) // 4
        want.append((d, hashlib.sha256((t[: len(t) - q] + n[:q]).encode()).hexdigest()))
    assert sorted(map(repr, ((r.doc_id, r.edited_sha256) for r in rows))) == sorted(map(repr, want))


def test_blocks_count_bounds(spark):
    for n in (0, 1, 64, 65, 1000):
        bounds = sorted(i * 7 % 501 for i in range(n))
        rows = spark.range(-5, 520).withColumn("b", block_of(F.col("id"), bounds)).collect()
        assert all(r.b == sum(b <= r.id for b in bounds) for r in rows)


def test_empty_table(documents):
    assert sketch.version_fingerprints(documents([])).collect() == []


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.sets(st.integers(0, 2**64 - 1), max_size=150), st.sets(st.integers(0, 2**64 - 1), max_size=150), st.sets(st.integers(0, 2**64 - 1), max_size=150)), max_size=6))
def test_peeling_recovers_all_that_differs(cases):
    as_keys = lambda s: np.array(sorted(s), dtype=np.uint64)
    a, b = [as_keys(x | c) for x, _, c in cases], [as_keys(y | c) for _, y, c in cases]
    got = sketch.differing(a, b)
    for g, (x, y, c) in zip(got, cases, strict=True):
        assert g.tolist() == sorted((x | c) ^ (y | c))


def test_repeats_count():
    assert len(set(sketch.digests("A.\nA.\nA.\nB.").tolist())) == 4
