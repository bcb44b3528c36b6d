import struct
import zlib

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from amalgam.llm import bpe, token_files

LIBRARY = Tokenizer.from_file(bpe.default_vocabulary())


def check(rows, docs):
    """docs: (doc_id, text) in file order."""
    at = 0
    rows = sorted(rows, key=lambda r: r.start)
    assert len(rows) == len(docs)
    for r, (d, t) in zip(rows, docs):
        ids = [*LIBRARY.encode(t or "", add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d, at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        at += len(ids)


def test_documents_equal_the_library(spark, sf_dir):
    docs = sorted((d.doc_id, d.text) for d in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    check(token_files.op7_token_id_files(spark, sf_dir).collect(), docs)


def test_edges_in_small_files(documents, edge_texts):
    check(token_files.checksums(documents(edge_texts), file_ids=3).collect(), list(enumerate(edge_texts)))


def test_null_and_repeated_ids(documents):
    docs = documents(["b", "a", None, "a"], ids=[5, 5, None, 5])
    check(token_files.checksums(docs).collect(), [(None, None), (5, "a"), (5, "a"), (5, "b")])


def test_hot_ids_in_many_blocks(documents):
    texts = [f"{chr(97 + i % 26)} number {i}" for i in range(400)]
    ids = [None if i % 2 else 9 if i % 4 else i for i in range(400)]
    order = sorted(zip(ids, texts), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    check(token_files.checksums(documents(texts, ids=ids), file_ids=40, blocks=20).collect(), order)


def test_any_file_system_that_spark_writes(spark, documents, edge_texts, tmp_path):
    """A folder whose scheme only Hadoop knows, and one file for each few documents in it."""
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.tokens.link./out", f"file://{tmp_path}")
    folder = "viewfs://tokens/out/files"
    docs = documents(edge_texts)
    token_files.write_token_files(docs, folder, file_ids=3)
    rows = token_files.read_token_files(spark, folder)
    check(rows.selectExpr("doc_id", "start", "n_tokens", "crc32(ids) AS ids_crc32").collect(), list(enumerate(edge_texts)))
    told = token_files.headers(spark, folder).collect()
    assert len(told) > 3  # an empty task may leave an empty file, which is none
    assert sum(r.n_docs for r in told) == len(edge_texts) and len({(r.block, r.part) for r in told}) == len(told)


def test_blocks_follow_the_size_of_the_input(spark, documents, monkeypatch):
    from amalgam.llm import common

    docs = documents(["some words"] * 300)
    assert common.default_blocks(docs) == 32
    monkeypatch.setattr(common, "BLOCK_ROWS", 5)
    assert common.default_blocks(docs) == 60
    monkeypatch.setattr(common, "MOST_BLOCKS", 50)
    assert common.default_blocks(docs) == 50
    check(token_files.checksums(docs).collect(), [(i, "some words") for i in range(300)])


def test_empty_table(documents):
    assert token_files.checksums(documents([])).collect() == []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 64), st.integers(1, 400), st.integers(0, 2**64 - 1)), max_size=12))
def test_words_round_trip(runs):
    values = np.concatenate([np.empty(0, np.uint64), *(np.array([(x * (i + 1) * 0x9E3779B97F4A7C15) % 2**64 >> (64 - bits) if bits else 0 for i in range(n)], np.uint64) for bits, n, x in runs)])
    words, offsets = token_files.pack(values)
    assert (token_files.unpack(words) == values).all() and len(token_files.unpack(words)) == len(values)
    assert len(offsets) == -(-len(values) // token_files.BLOCK) + 1 and offsets[-1] == len(words)
    for b in range(len(offsets) - 1):
        assert (token_files.unpack(words[offsets[b] : offsets[b + 1]]) == values[b * token_files.BLOCK : (b + 1) * token_files.BLOCK]).all()


def test_sizes():
    assert len(token_files.pack(np.zeros(60, np.uint64))[0]) == 1
    assert len(token_files.pack(np.full(3, 2**20 - 1, np.uint64))[0]) == 1
    assert len(token_files.pack(np.full(3, 2**63, np.uint64))[0]) == 6


def test_file_and_single_blocks():
    rng = np.random.default_rng(0)
    ids = [rng.integers(0, 50_257, n).astype(np.uint32) for n in (1, 3000, 2, 700)]
    content = token_files.file_bytes([4, None, 6, 7], [len(i) for i in ids], np.concatenate(ids))
    doc_ids, lengths, offsets, _, back = token_files.read_file(content)
    assert doc_ids == [4, None, 6, 7] and lengths.tolist() == [1, 3000, 2, 700] and (back == np.concatenate(ids)).all()
    assert (np.concatenate([token_files.read_block(content, b) for b in range(len(offsets) - 1)]) == back).all()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'sltx1.,é日\u2003<|>"), st.characters(exclude_categories=["Cs"])), max_size=40), max_size=8))
def test_any_texts_equal_the_library(texts):
    ids, lengths = token_files.library_encoder(bpe.default_vocabulary()).encode(pa.array(texts, pa.string()))
    want = [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]
    assert lengths.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_known_pieces_are_bounded(monkeypatch):
    monkeypatch.setattr(token_files, "REMEMBERED", 50)
    encoder = token_files.LibraryEncoder(bpe.default_vocabulary())
    rng = np.random.default_rng(0)
    for _ in range(20):
        texts = [" ".join(f"w{k}" for k in rng.integers(0, 300, 40)) for _ in range(3)]
        ids, lengths = encoder.encode(pa.array(texts, pa.string()))
        want = [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]
        assert lengths.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
        assert len(encoder.pieces) <= 50 + 120
