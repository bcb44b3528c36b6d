"""Packing by powers of two: each document's ids are cut into pieces of binary lengths, and equal lengths share a bucket.

A document of n ids gives n // 4096 pieces of 4096 and one piece for every set bit of the rest, longest first. Each piece is a
sequence of its own, so no sequence crosses documents and none needs padding. A sequence's number tells its bucket (the
length's binary logarithm), the task that cut it and its place among that task's pieces of the bucket, in 5, 25 and 33 bits:
numbers are unique, rise bucket by bucket, and need no pass over other tasks' counts.

Null and empty texts are the end id alone, one sequence of length 1; very long texts are encoded whole; rows are independent,
so ties, repeated rows and null doc_ids give pieces like any others; further columns, whatever their names, are not read; an
empty table gives no row.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from amalgam.llm.common import table
from amalgam.llm.token_files import LibraryEncoder

END_ID, LONGEST = 2, 4096
TASK_BITS, PLACE_BITS = 25, 33


def default_words() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder(LibraryEncoder):
    """The library's ids for a vocabulary that drops white space; pieces between ASCII white space that were seen lately are remembered.

    No word and no added token of such a vocabulary reaches over white space, and nothing composes with it, so a text's ids are
    those of its pieces one after another. A file that treats white space otherwise is refused.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        told = self.ids(["a", "b", "a b", " a\t\n b ", "", " ", "1", "1 1", "'", "s", "' s", "..", ".. .."])
        a, b, both, spaced, none, blank, one, ones, mark, letter, apart, dots, twice = np.split(told[0].astype(np.int64), np.cumsum(told[1])[:-1])
        same = [(np.r_[a, b], both), (both, spaced), (none, blank), (np.r_[one, one], ones), (np.r_[mark, letter], apart), (np.r_[dots, dots], twice)]
        if len(none) or not all(np.array_equal(x, y) for x, y in same):
            raise ValueError("this vocabulary does not drop white space")
        self.pieces = pa.array([""], pa.string())
        self.known_ids, self.lengths = np.empty(0, "<u4"), np.zeros(1, np.int64)
        self.used, self.tick = np.zeros(1, np.int64), 0

    def ids_of_pieces(self, pieces: list[str], together: int = 0) -> tuple[np.ndarray, np.ndarray]:
        return self.ids(pieces)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        cut = pc.ascii_split_whitespace(texts)
        flat = cut.flatten()
        coded = flat.dictionary_encode()
        which = self.places(coded.dictionary)[coded.indices.to_numpy()]
        values = pa.LargeListArray.from_arrays(pa.array(np.r_[0, np.cumsum(self.lengths)]), pa.array(self.known_ids))
        upto = np.r_[0, np.cumsum(self.lengths[which])]
        return values.take(pa.array(which)).flatten().to_numpy(), np.diff(upto[cut.offsets.to_numpy() - cut.offsets[0].as_py()])


@lru_cache(maxsize=1)
def word_encoder(path: str) -> WordEncoder:
    """One for each worker process, so that what is remembered serves all of its tasks."""
    return WordEncoder(path)


def cuts(n: int, longest: int = LONGEST) -> list[int]:
    """The lengths of a document's pieces, longest first. ``longest`` is a power of two."""
    return [longest] * (n // longest) + [1 << k for k in range(longest.bit_length() - 2, -1, -1) if n % longest >> k & 1]


def packed(docs: DataFrame, path: str | None = None, longest: int = LONGEST) -> DataFrame:
    """Pieces: doc_id, start, length, doc_tokens, bucket, sequence_id, offset and ids (little-endian unsigned 32-bit)."""
    if longest < 1 or longest & (longest - 1):
        raise ValueError("the longest sequence must be a power of two")
    path = path or default_words()
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("bucket", pa.int32()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(path)
        seen = [0] * longest.bit_length()
        for batch in batches:
            for some in (batch.slice(i, 1000) for i in range(0, batch.num_rows, 1000)):
                found, lengths = encoder.encode(some.column(2))
                ends = np.cumsum(lengths)
                ids = np.insert(found, ends, END_ID).astype("<u4")  # each document's ids, then the end id
                rows, sizes = [], []
                for task, doc_id, n in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), (lengths + 1).tolist(), strict=True):
                    start = 0
                    for size in cuts(n, longest):
                        bucket = size.bit_length() - 1
                        rows.append((doc_id, start, size, n, bucket, (bucket << TASK_BITS | task) << PLACE_BITS | seen[bucket], 0))
                        seen[bucket] += 1
                        start += size
                        sizes.append(size)
                at = pa.array(4 * np.r_[0, np.cumsum(sizes, dtype=np.int64)])
                raw = pa.Array.from_buffers(pa.large_binary(), len(rows), [None, at.buffers()[1], pa.py_buffer(ids)])
                for first in range(0, len(rows), 4_000):
                    part = raw.slice(first, 4_000).cast(pa.binary())
                    columns = [pa.array(c, f.type) for c, f in zip(zip(*rows[first : first + 4_000], strict=True), schema, strict=False)]
                    yield pa.RecordBatch.from_arrays([*columns, part], schema=schema)

    rows = docs.select(F.spark_partition_id().alias("task"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, start long, length long, doc_tokens long, bucket int, sequence_id long, offset long, ids binary")


def write_buckets(pieces: DataFrame, folder: str) -> None:
    """Write the sequences as Parquet, a folder for each bucket, so that a trainer reads batches of one length."""
    pieces.write.partitionBy("bucket").parquet(folder)


def op12_power_of_two_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packed(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")
