import random
import re

import numpy as np
import pyspark.sql.functions as F
import xxhash

import corpus_pipeline
from amalgam.llm import simhash


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words)] if len(words) < 3 else [" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, fps, most=2):
    parent = list(range(len(ids)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= most:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(least.get(find(i), d), d)
    return {d: least[find(i)] for i, d in enumerate(ids)}


def test_documents_equal_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    fps = [brute_fingerprint(d.text) for d in docs]
    want = brute_components([d.doc_id for d in docs], fps)
    got = simhash.op5_simhash_near_dedup(spark, sf_dir).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {d.doc_id: (f"{f:016x}", want[d.doc_id]) for d, f in zip(docs, fps)}


def test_edges(documents, edge_texts):
    got = simhash.near_duplicates(documents(edge_texts)).collect()
    fps = [brute_fingerprint(t) for t in edge_texts]
    want = brute_components(list(range(len(edge_texts))), fps)
    assert {r.doc_id: (r.fp % 2**64, r.component_id) for r in got} == {i: (f, want[i]) for i, f in enumerate(fps)}


def test_all_pairs_within_two_bits_meet_under_an_anchor():
    rng = random.Random(3)
    for _ in range(300):
        x = rng.getrandbits(64)
        y = x ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 2)))
        at, who = simhash.anchors(np.array([x, y], dtype=np.uint64))
        mine = [set(at[who == np.uint64(v)].tolist()) for v in (x, y)]
        assert mine[0] & mine[1] and len(mine[0]) <= 34


def test_links_of_random_clusters_equal_brute_force(spark):
    rng = random.Random(5)
    fps = set()
    for _ in range(30):
        x = rng.getrandbits(64)
        for _ in range(12):
            fps.add(x)
            x ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 3)))
    fps = sorted(fps)
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    links = simhash.fingerprint_links(spark.createDataFrame([(s,) for s in signed], "fp long"))
    part = {r.node: r.component for r in simhash.connected_components(links, 100).collect()}
    want = brute_components(signed, fps)
    assert {s: part.get(s, s) for s in signed} == want


def test_lookup_by_bits_equals_pairwise(monkeypatch):
    rng = random.Random(7)
    x = rng.getrandbits(64)
    fps = np.unique(np.array([x ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for _ in range(400)], dtype=np.uint64))
    want = simhash.star_links(fps)
    monkeypatch.setattr(simhash, "PAIRWISE", 10)
    assert (simhash.star_links(fps) == want).all()


def test_groups_of_copies_and_null_ids(documents):
    rows = simhash.near_duplicates(documents(["same text here"] * 50 + ["other words stand here now"], ids=[None, *range(10, 60)])).collect()
    assert sorted({r.component_id for r in rows}) == [10, 59]
    assert len(rows) == 51


def test_kept_keeps_one_row_a_group_and_columns(documents):
    docs = documents(["same text here"] * 5 + ["quite another text", None, ""])
    out = simhash.kept_rows(docs)
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == [0, 5, 6]


def test_groups_without_any_id_keep_one(documents):
    texts = ["same text here", "same text here", "quite another text that is long", "a third one of them"]
    out = simhash.kept_rows(documents(texts, ids=[None, None, None, 4])).collect()
    assert sorted(r.text for r in out) == ["a third one of them", "quite another text that is long", "same text here"]
    out = simhash.kept_rows(documents(["same text here", "same text here", "Same  TEXT here"], ids=[None, 9, 3])).collect()
    assert [r.doc_id for r in out] == [3]
    out = simhash.kept_rows(documents(["x y z w", "x y z w"], ids=[7, 7])).collect()
    assert [(r.doc_id, r.text) for r in out] == [(7, "x y z w")]


def test_large_anchors_in_parts_equal_brute_force(spark):
    """One half alike in all fingerprints, so that they share its anchors, dealt to parts of a few."""
    rng = random.Random(11)
    fps = {(0xABCDEF01 << 32) | rng.getrandbits(32) for _ in range(150)}
    fps |= {f ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 3))) for f in list(fps)[:100]}
    fps = sorted(fps)
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    links = simhash.fingerprint_links(spark.createDataFrame([(s,) for s in signed], "fp long"), most=16)
    part = {r.node: r.component for r in simhash.connected_components(links, 100).collect()}
    assert {s: part.get(s, s) for s in signed} == brute_components(signed, fps)


def test_stage_keeps_one_row_a_group(spark, documents):
    texts = ["same text here"] * 40 + ["quite another text that is long"] * 3 + ["", None, ""]
    docs = documents(texts, ids=[None] * 40 + [7, 7, None] + [None] * 3).repartition(5)
    out = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert out.columns == docs.columns
    got = out.collect()
    assert sorted((str(r.doc_id), " ".join((r.text or "").lower().split())) for r in got) == [("7", "quite another text that is long"), ("None", ""), ("None", "same text here")]
    assert corpus_pipeline.drop_near_copies(spark, documents([]), "").collect() == []


def test_empty_table(documents):
    assert simhash.near_duplicates(documents([])).collect() == []
    assert documents([]).filter(F.lit(True)).count() == 0


def test_kept_rows_with_columns_that_have_no_hash(spark):
    """Maps, nested ones, and names with dots or quotes go along, where rows are repeated too."""
    rows = [(7, "x y z w", {"a": 1}, [{"k": {"b": 2}}], "p"), (7, "x y z w", {"a": 1}, [{"k": {"b": 2}}], "p"), (7, "x y z w", {"a": 0}, None, "q"), (8, "other words stand here", {"c": 3}, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, m map<string,int>, `a.b` array<struct<k:map<string,int>>>, `q``t` string")
    docs = docs.selectExpr("*", "parse_json('{\"v\": 1}') AS variant")
    out = simhash.kept_rows(docs).select("doc_id", "m", "`a.b`", "`q``t`").collect()
    assert sorted(r.doc_id for r in out) == [7, 8]
    assert [r for r in out if r.doc_id == 8][0].m == {"c": 3}
    again = simhash.kept_rows(docs.repartition(5)).select("doc_id", "m", "`a.b`", "`q``t`").collect()
    assert sorted(map(repr, out)) == sorted(map(repr, again))
