"""BPE encoding and decoding: merge ranks in a priority queue over a doubly linked symbol list.

Null texts count as empty; empty texts give no ids and decode to the empty string. Very long texts and very long words
are encoded whole in O(n log n). Rows are independent, so ties, repeated rows, null doc_ids and further columns do not
matter. Of merges of equal rank (ties) in a word the leftmost comes first. An empty table gives no row.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from amalgam.llm.common import table

#: The pre-tokenisation pattern that byte-level tokenizer files of this kind imply.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Longest chunk that is remembered, and how many chunks a generation of the memory holds.
CHUNK, REMEMBERED = 48, 250_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in set(own))}
    return [chr(rest.get(b, b)) for b in range(256)]


class Remembering(dict):
    """A mapping that computes what it lacks; two generations bound its memory."""

    def __init__(self, compute, limit: int = REMEMBERED):
        super().__init__()
        self.compute, self.limit, self.old = compute, limit, {}

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        if len(key) <= CHUNK:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


def refused(spec: dict) -> list[str]:
    """What a vocabulary file asks for that this encoder does not do."""
    model, before, after = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("decoder") or {}
    asked = {f"model.{k}": model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")}
    asked |= {"normalizer": spec.get("normalizer"), "pre_tokenizer.add_prefix_space": before.get("add_prefix_space")}
    asked |= {f"added_tokens.{k}": any(t.get(k) for t in spec["added_tokens"]) for k in ("single_word", "lstrip", "rstrip")}
    wrong = [k for k, v in asked.items() if v]
    if model.get("type", "BPE") != "BPE" or before.get("type") != "ByteLevel" or after.get("type") != "ByteLevel" or not before.get("use_regex", True):
        wrong.append("another model, pre_tokenizer or decoder than byte-level BPE by the usual pattern")
    return wrong


class Encoder:
    """Encodes and decodes with a byte-level BPE vocabulary file in the tokenizers library's JSON form.

    A file that asks for more than a vocabulary, merges and plain added tokens is refused.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if wrong := refused(spec):
            raise ValueError(f"this vocabulary file can't be used: {', '.join(wrong)}")
        vocab = spec["model"]["vocab"]
        symbols = byte_symbols()
        back = {s: bytes([b]) for b, s in enumerate(symbols)}
        self.first = [vocab[s] for s in symbols]
        self.merges = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ", 1)
            self.merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = {k: np.uint32(v).tobytes() for k, v in added.items()}
        self.strings = [b""] * (1 + max([*vocab.values(), *added.values()]))
        for s, i in vocab.items():
            self.strings[i] = b"".join(map(back.__getitem__, s))
        for s, i in added.items():
            self.strings[i] = s.encode()
        self.cut_special = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.words = regex.compile(WORDS)
        self.odd_space = regex.compile(r"\s ")
        self.before_space = regex.compile(r"(?<=\S)(?= )")
        self.word_ids = Remembering(self.merged)
        self.head = Remembering(self.chunk)
        self.tail = Remembering(lambda part: self.chunk(" " + part))

    def merged(self, word: str) -> bytes:
        """Merge a word's bytes, lowest rank first and leftmost first among equals."""
        ids = [self.first[b] for b in word.encode()]
        n, merges = len(ids), self.merges
        if n > 1:
            before, after = list(range(-1, n - 1)), list(range(1, n + 1))
            queue = [(m[0], i, m[1]) for i in range(n - 1) if (m := merges.get((ids[i], ids[i + 1])))]
            heapify(queue)
            alive = bytearray(b"\x01") * n
            while queue:
                rank, i, made = heappop(queue)
                j = after[i] if alive[i] else n
                if j >= n or merges.get((ids[i], ids[j])) != (rank, made):
                    continue  # stale: a neighbour has been merged since
                ids[i] = made
                alive[j] = 0
                after[i] = k = after[j]
                if k < n:
                    before[k] = i
                    if m := merges.get((made, ids[k])):
                        heappush(queue, (m[0], i, m[1]))
                h = before[i]
                if h >= 0 and (m := merges.get((ids[h], made))):
                    heappush(queue, (m[0], h, m[1]))
            ids = [x for x, a in zip(ids, alive, strict=True) if a]
        return np.array(ids, dtype="<u4").tobytes()

    def chunk(self, text: str) -> bytes:
        return b"".join(map(self.word_ids.__getitem__, self.words.findall(text)))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.cut_special and (parts := self.cut_special.split(text))[1:]:
            return b"".join(self.special.get(p) or self.encode_plain(p) for p in parts)
        return self.encode_plain(text)

    def encode_plain(self, text: str) -> bytes:
        # No word reaches over a space that follows a non-space, so those spaces cut the text into remembered chunks.
        if self.odd_space.search(text):
            return b"".join(map(self.head.__getitem__, self.before_space.split(text)))
        first, *rest = text.split(" ")
        return self.head[first] + b"".join(map(self.tail.__getitem__, rest)) if first or not rest else b"".join(map(self.tail.__getitem__, rest))

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.strings.__getitem__, np.frombuffer(ids, dtype="<u4").tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode_decode(docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the key, n_tokens, ids (binary, little-endian unsigned 32-bit) and the decoded text."""
    path = path or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in batches:
            for part in (batch.slice(i, 1000) for i in range(0, batch.num_rows, 1000)):
                ids = [bpe.encode(t or "") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(map(bpe.decode, ids), pa.string())],
                    names=["key", "n_tokens", "ids", "decoded"],
                )

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "key long, n_tokens long, ids binary, decoded string").withColumnRenamed("key", key)


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    return encode_decode(docs, path).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


def op3_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
