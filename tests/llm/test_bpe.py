import hashlib
import json
import struct

from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from amalgam.llm import bpe

LIBRARY = Tokenizer.from_file(bpe.default_vocabulary())


def check(rows, texts):
    for r, t in zip(rows, texts):
        ids = LIBRARY.encode(t or "", add_special_tokens=False).ids
        raw = struct.pack(f"<{len(ids)}I", *ids)
        decoded = LIBRARY.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())


def test_edges_equal_the_library(documents, edge_texts):
    rows = sorted(bpe.digests(documents(edge_texts)).collect(), key=lambda r: r.doc_id)
    check(rows, edge_texts)


def test_documents_equal_the_library(spark, sf_dir):
    rows = sorted(bpe.op3_bpe_encode_decode(spark, sf_dir).collect(), key=lambda r: r.doc_id)
    docs = sorted(spark.read.parquet(f"{sf_dir}/documents.parquet").collect(), key=lambda r: r.doc_id)
    assert [r.doc_id for r in rows] == [d.doc_id for d in docs]
    check(rows, [d.text for d in docs])


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'sltx1.,é日🙂<|>"), st.characters(exclude_categories=["Cs"]))))
def test_any_text_equals_the_library(text):
    encoder = bpe.encoder(bpe.default_vocabulary())
    ids = LIBRARY.encode(text, add_special_tokens=False).ids
    got = encoder.encode(text)
    assert list(struct.unpack(f"<{len(got) // 4}I", got)) == ids
    assert encoder.decode(got) == LIBRARY.decode(ids, skip_special_tokens=False)


def test_memory_of_chunks_is_bounded():
    memory = bpe.Remembering(lambda k: k.encode(), limit=3)
    assert [memory[k] for k in "abcdabcd"] == [k.encode() for k in "abcdabcd"]
    assert len(memory) <= 3 and len(memory.old) <= 3


def test_empty_table(documents):
    assert bpe.digests(documents([])).collect() == []


def test_other_vocabulary_files_are_refused():
    with open(bpe.default_vocabulary(), encoding="utf-8") as f:
        spec = json.load(f)
    assert bpe.refused(spec) == []
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "use_regex": True}}, {"model": spec["model"] | {"byte_fallback": True}},
                   {"added_tokens": [{"id": 1, "content": "x", "lstrip": True}]}):
        assert bpe.refused(spec | change)
