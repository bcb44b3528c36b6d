import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from amalgam.llm import packing
from amalgam.llm.bpe import default_vocabulary


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(packing.default_words())
    t.no_truncation()
    t.no_padding()
    return t


def check(pieces, docs, library, longest=4096):
    """Every document's pieces, in order, are its ids; lengths are the binary digits; no sequence is shared."""
    by_doc = {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
    assert len({p.sequence_id for p in pieces}) == len(pieces) and all(p.offset == 0 for p in pieces)
    assert set(by_doc) == {d for d, _ in docs}
    for doc_id, text in docs:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, packing.END_ID], "<u4")
        at = 0
        own = sorted(by_doc[doc_id], key=lambda p: p.start)
        for p in own:
            assert p.start == at and p.doc_tokens == len(ids) and p.length <= longest and p.length & (p.length - 1) == 0 and p.bucket == p.length.bit_length() - 1
            assert p.sequence_id >> (packing.TASK_BITS + packing.PLACE_BITS) == p.bucket
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
        assert len(own) == len(ids) // longest + (len(ids) % longest).bit_count()  # no fewer pieces of powers of two are possible


def digest(pieces):
    from pyspark.sql import functions as F

    return pieces.withColumn("ids_crc32", F.crc32("ids"))


def test_documents(spark, sf_dir, library):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    check(packing.op12_power_of_two_packing(spark, sf_dir).collect(), docs, library)


def test_edges(spark, documents, edge_texts, library):
    texts = [*edge_texts, "İstanbul ΣΑΣ ﬁ Å", "é ́x ≮", "a\x0bb\x0cc\x85d\xa0e f\x1cg", "IT'S we'LL 'd''s", "<|startoftext|>a <|END|> b<|endoftext|>", "...,,,!!! 12 3½ x²"]
    for longest in (4096, 64, 1):
        some = texts if longest > 1 else texts[:6]
        check(digest(packing.packed(documents(some).repartition(3), longest=longest)).collect(), list(enumerate(some)), library, longest)
    assert packing.packed(documents([])).collect() == []


def test_repeated_rows_and_rows_without_id(documents, library):
    rows = packing.packed(documents(["same text"] * 4 + [None], ids=[None, None, 5, 5, None])).collect()
    assert len({r.sequence_id for r in rows}) == len(rows)
    n = len(library.encode("same text").ids) + 1
    assert sum(r.length for r in rows if r.doc_id is None) == 2 * n + 1 and sum(r.length for r in rows if r.doc_id == 5) == 2 * n


def test_buckets_are_written_apart(spark, documents, tmp_path):
    pieces = packing.packed(documents(["one two three", "four", "word " * 9000]))
    packing.write_buckets(pieces, f"file://{tmp_path}/packed")
    back = spark.read.parquet(f"file://{tmp_path}/packed")
    assert {(r.bucket, r.length, len(r.ids) // 4) for r in back.collect()} == {(p.bucket, p.length, p.length) for p in pieces.collect()}
    assert (tmp_path / "packed" / "bucket=12").is_dir()


def test_refusals(documents):
    with pytest.raises(ValueError, match="power of two"):
        packing.packed(documents(["a"]), longest=100)
    with pytest.raises(ValueError, match="white space"):
        packing.WordEncoder(default_vocabulary())


def test_memory_of_pieces_is_bounded(monkeypatch, library):
    import pyarrow as pa

    from amalgam.llm import token_files

    monkeypatch.setattr(token_files, "REMEMBERED", 50)
    encoder = packing.WordEncoder(packing.default_words())
    for k in range(12):
        texts = [f"w{k}x{i} common word" for i in range(30)]
        ids, lengths = encoder.encode(pa.array(texts))
        want = [library.encode(t, add_special_tokens=False).ids for t in texts]
        assert lengths.tolist() == [len(w) for w in want] and ids.tolist() == sum(want, [])
    assert len(encoder.pieces) < 150
