import zlib

from pyspark.sql import functions as F

from amalgam.llm import shards


def jump(key, n):
    key %= 2**64
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def check(rows, docs, n=24):
    assert len(rows) == len(docs)
    for s in range(n):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in rows) == sorted((str(d), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in docs)
    assert all(r.law == "key" and r.grown_shard in (r.shard, n) for r in rows)


def test_documents(spark, sf_dir):
    rows = shards.op8_sharding(spark, sf_dir).collect()
    check(rows, [(d.doc_id, d.text) for d in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()])


def test_jumps_equal_the_published_loop(spark):
    keys = [0, 1, -1, 2**63 - 1, -(2**63), *range(5, 4000, 97)]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for n in (1, 2, 24, 60):
        for r in shards.with_jump(df, F.col("k"), n).collect():
            assert (r.shard, r.grown_shard) == (jump(r.k, n), jump(r.k, n + 1)), (r, n)


def test_edges(documents, edge_texts):
    docs = documents(edge_texts * 2, ids=[None, None, *range(len(edge_texts) - 2), *[3] * len(edge_texts)])
    rows = shards.placed(docs).collect()
    check(rows, [(r.doc_id, r.text) for r in docs.collect()])
    assert len({r.shard for r in rows if r.doc_id is None}) == 1
    assert shards.placed(documents([])).collect() == []


def test_rows_equal_brute_force(spark, documents):
    """Shard, grown shard and slot of every row, from the hashes of the rows alone."""
    ids = [None, None, None, 7, 7, 7, 7, *range(100, 400)]
    texts = ["same", "same", "other", "same", "same", "x", None, *(f"text {i % 50}" for i in range(300))]
    docs = documents(texts, ids=ids).repartition(5)
    text = F.coalesce("text", F.lit(""))
    row = [F.col("doc_id"), F.crc32(text), (F.octet_length(text) + 8).cast("long")]
    known = docs.select(*[c.alias(n) for c, n in zip(row, ("d", "c", "s"))], F.xxhash64("doc_id").alias("k"), F.xxhash64(*row).alias("h")).collect()
    want = []
    for n in range(24):
        own = sorted((r.h % shards.PARTS, r.d is not None, r.d or 0, r.c, r.s, jump(r.k, 25)) for r in known if jump(r.k, 24) == n)
        want += [(d if there else None, s, c, n, slot, grown) for slot, (_, there, d, c, s, grown) in enumerate(own)]
    got = [(r.doc_id, r.size, r.text_crc32, r.shard, r.slot, r.grown_shard) for r in shards.placed(docs).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_a_hot_repeated_row_is_dealt_out(spark):
    n = 4000
    docs = spark.range(n).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.lit("same text").alias("text")).repartition(8)
    out = shards.placed(docs)
    rows = out.collect()
    check(rows, [(i if i % 3 else None, "same text") for i in range(n)])


def test_shares_are_near_equal_and_growth_moves_little(spark):
    df = spark.range(20_000).select(F.xxhash64("id").alias("k"))
    rows = shards.with_jump(df, F.col("k"), 24).collect()
    counts = [sum(r.shard == s for r in rows) for s in range(24)]
    assert max(counts) < 1.2 * 20_000 / 24 and min(counts) > 0.8 * 20_000 / 24
    moved = sum(r.shard != r.grown_shard for r in rows)
    assert 0.8 / 25 < moved / 20_000 < 1.2 / 25
