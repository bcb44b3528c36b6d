"""Token ids in files of Simple-8b words.

A file holds consecutive documents' ids: a header, the documents' ids and lengths, the word offset of each block of 1024
token ids, and 64-bit words. A word's top four bits select how many ids of how many bits it packs; selector 15 is an
escape, after which the next word holds one id of more than 60 bits as it is. Blocks start at a word of their own, so any
block can be decoded alone; packing and decoding run over all blocks of a file at once in numpy.

Documents are written in ascending doc_id (none first, equal ones by text) in blocks of ids; a file's header names its block
and part, and a file comes before those of later parts and blocks. Spark's own writer puts the bytes into the folder, a file
for each row, on any file system that Spark can write, and commits them, so a repeated task leaves one file; the line end
that it adds is not read. Null and empty texts give the end id only; very long texts are encoded whole; repeated rows
are documents of their own, and ties between equal rows change nothing; further columns, whatever their names, are not
read; an empty table gives no file.
"""

from __future__ import annotations

import gc
import os
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from amalgam.llm.bpe import Encoder, default_vocabulary
from amalgam.llm.common import saved, scratch_path, table
from amalgam.llm.sketch import in_id_order

END_ID, FILE_IDS, BLOCK, REMEMBERED = 2, 1 << 20, 1024, 500_000
#: Fixed values of the coding: how many ids of how many bits, by selector.
SELECTORS = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
ESCAPE = 15
COUNTS = np.array([*(c for c, _ in SELECTORS), 0, 1])
#: Bits of every id of 16 bits.
SMALL = np.maximum(np.frexp(np.arange(1 << 16, dtype=np.float64))[1], 1).astype(np.uint8)
#: White space (in Unicode's sense) before a space or a line end, or after a line end.
_WHITE = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
ODD_SPACE = rf"{_WHITE}[ \n]|\n{_WHITE}"
#: Header: magic, block and part, then the numbers of documents, ids, blocks of ids and words, most significant byte first.
MAGIC, HEADER = b"AMS8", struct.Struct(">4s2I4Q")


def widths(values: np.ndarray) -> np.ndarray:
    """Bits of each value (one at least; a large value may count one too many, which only makes it an escape)."""
    if len(values) and values.max() < len(SMALL):
        return SMALL[values]
    return np.maximum(np.frexp(values.astype(np.float64))[1], 1).astype(np.uint8)


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words, and the first word of each block (and the end)."""
    values = values.astype(np.uint64)
    n = len(values)
    blocks = -(-n // BLOCK)
    if not n:
        return np.empty(0, np.uint64), np.zeros(1, np.int64)
    longest = SELECTORS[0][0]
    width = np.full(blocks * BLOCK, 255, np.uint8)
    width[:n] = widths(values)
    most = {1: np.pad(width.reshape(blocks, BLOCK), ((0, 0), (0, longest)), constant_values=255)}
    counts = sorted(c for c, _ in SELECTORS)
    for k, c in zip(counts, counts[1:]):  # each count is at most twice the one before
        a = most[k]
        most[c] = np.maximum(a[:, : a.shape[1] - (c - k)], a[:, c - k :])
    # where a selector's ids fit, those of the next one (fewer of more bits) fit too, so the misfits tell the first that fits
    select = np.zeros((blocks, BLOCK), np.uint8)
    for c, bits in SELECTORS:
        select += most[c][:, :BLOCK] > bits
    select[select == len(SELECTORS)] = ESCAPE
    lane, at = np.arange(blocks), np.zeros(blocks, np.int64)
    size = np.minimum(n - lane * BLOCK, BLOCK)
    steps = []
    while (going := at < size).any():
        steps.append(np.where(going, at, -1))
        at = at + np.where(going, COUNTS[select[lane, np.minimum(at, BLOCK - 1)]], 0)
    grid = np.stack(steps, 1)
    start = (grid + (lane * BLOCK)[:, None])[grid >= 0]
    chosen = select.reshape(-1)[start]
    span = 1 + (chosen == ESCAPE)
    where = np.cumsum(span) - span
    words = np.zeros(int(span.sum()), np.uint64)
    for s, (c, bits) in enumerate(SELECTORS):
        own = chosen == s
        if own.any():
            first = start[own]
            word = np.full(len(first), np.uint64(s) << np.uint64(60), np.uint64)
            for j in range(c):
                word |= values[first + j] << np.uint64(j * bits)
            words[where[own]] = word
    own = chosen == ESCAPE
    words[where[own]] = np.uint64(ESCAPE) << np.uint64(60)
    words[where[own] + 1] = values[start[own]]
    of_block = np.add.reduceat(span, np.r_[0, np.cumsum((grid >= 0).sum(axis=1))[:-1]])
    return words, np.r_[0, np.cumsum(of_block)]


def unpack(words: np.ndarray) -> np.ndarray:
    """All values of consecutive blocks' words."""
    select = (words >> np.uint64(60)).astype(np.uint8)
    raw = np.zeros(len(words), bool)
    for i in np.flatnonzero(select == ESCAPE):  # escapes are rare; a raw word may look like one
        if not raw[i]:
            raw[i + 1] = True
    count = np.where(raw, 0, COUNTS[select])
    start = np.cumsum(count) - count
    out = np.empty(int(count.sum()), np.uint64)
    for s, (c, bits) in enumerate(SELECTORS):
        own = np.flatnonzero((select == s) & ~raw)
        word, first, mask = words[own], start[own], np.uint64((1 << bits) - 1)
        for j in range(c):
            out[first + j] = (word >> np.uint64(j * bits)) & mask
    own = np.flatnonzero((select == ESCAPE) & ~raw)
    out[start[own]] = words[own + 1]
    return out


def file_bytes(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, block: int = 0, part: int = 0) -> bytes:
    words, offsets = pack(ids)
    parts = [np.array([d or 0 for d in doc_ids], "<i8"), np.array([d is not None for d in doc_ids], "u1"), np.array(lengths, "<i8"), offsets.astype("<i8"), words.astype("<u8")]
    return HEADER.pack(MAGIC, block, part, len(doc_ids), len(ids), len(offsets) - 1, len(words)) + b"".join(p.tobytes() for p in parts)


def read_file(content: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, each document's length, block offsets, words and all ids of a file."""
    magic, _, _, n_docs, n_ids, n_blocks, n_words = HEADER.unpack_from(content)
    if magic != MAGIC:
        raise ValueError("not a token file")
    at = HEADER.size
    out = []
    for kind, n in (("<i8", n_docs), ("u1", n_docs), ("<i8", n_docs), ("<i8", n_blocks + 1), ("<u8", n_words)):
        out.append(np.frombuffer(content, kind, n, at))
        at += out[-1].nbytes
    ids = unpack(out[4])
    if len(ids) != n_ids:
        raise ValueError("a token file is damaged")
    return [int(d) if known else None for d, known in zip(out[0], out[1], strict=True)], out[2], out[3], out[4], ids


def place(content: bytes) -> tuple[int, int]:
    """Block and part of a file."""
    return HEADER.unpack_from(content)[1:3]


def read_block(content: bytes, block: int) -> np.ndarray:
    """The ids of one block alone."""
    _, _, _, n_docs, _, n_blocks, n_words = HEADER.unpack_from(content)
    at = HEADER.size + 17 * n_docs
    first, end = np.frombuffer(content, "<i8", n_blocks + 1, at)[block : block + 2]
    return unpack(np.frombuffer(content, "<u8", int(end - first), at + 8 * (n_blocks + 1) + 8 * int(first)))


class LibraryEncoder:
    """The tokenizers library's ids; chunks between spaces that were seen lately are remembered.

    No word of the library's pre-tokenizer reaches over a space that follows a non-space, nor over a line end between
    non-spaces, so a text's ids are those of the pieces that these cut. A piece has a space before it, or starts with a line
    end and has none. Arrow cuts a batch of texts and tells its distinct pieces; new ones go to the library many in one
    text, in which a piece's ids start with the only one whose string starts so. Texts with other runs of white space, or
    with an added token, go whole. Known pieces and their ids are Arrow and numpy arrays; when there are too many, those
    that were not used lately go.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        own = Encoder(path)
        self.added = [s for s in own.special if s]
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.starts = np.array([x[:1] in (b" ", b"\n") for x in own.strings])
        # only a space at a text's end leaves an empty piece
        self.pieces = pa.array([""], pa.string())
        self.known_ids, self.lengths = self.ids([" "])
        self.used, self.tick = np.zeros(1, np.int64), 0

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts one after another, and how many each has."""
        found = [np.array(e.ids, "<u4") for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate([np.empty(0, "<u4"), *found]), np.array([len(f) for f in found], np.int64)

    def ids_of_pieces(self, pieces: list[str], together: int = 500) -> tuple[np.ndarray, np.ndarray]:
        """The same for pieces, with a space before each that doesn't start with a line end; none holds an added token."""
        placed = [p if p[0] == "\n" else " " + p for p in pieces]
        parts = [placed[i : i + together] for i in range(0, len(placed), together)]
        ids, lengths = [np.empty(0, "<u4")], [np.empty(0, np.int64)]
        for part, e in zip(parts, self.library.encode_batch_fast(["".join(p) for p in parts], add_special_tokens=False), strict=True):
            found = np.array(e.ids, "<u4")
            at = np.flatnonzero(self.starts[found])
            size = np.diff(at, append=len(found))
            if len(at) != len(part) or at[0]:
                found, size = self.ids(part)
            ids.append(found)
            lengths.append(size)
        return np.concatenate(ids), np.concatenate(lengths)

    def places(self, pieces: pa.Array) -> np.ndarray:
        """Where distinct pieces stand among the known ones, after new ones have been added."""
        if len(self.pieces) > REMEMBERED:
            keep = self.used > np.partition(self.used, len(self.used) // 2)[len(self.used) // 2]
            keep[0] = True
            self.known_ids = self.known_ids[np.repeat(keep, self.lengths)]
            self.pieces, self.lengths, self.used = self.pieces.filter(pa.array(keep)), self.lengths[keep], self.used[keep]
        at = pc.fill_null(pc.index_in(pieces, value_set=self.pieces), -1).to_numpy().astype(np.int64)
        gaps = np.flatnonzero(at < 0)
        if len(gaps):
            new = pieces.take(pa.array(gaps))
            ids, lengths = self.ids_of_pieces(new.to_pylist())
            at[gaps] = len(self.pieces) + np.arange(len(gaps))
            self.pieces = pa.concat_arrays([self.pieces, new])
            self.known_ids, self.lengths, self.used = np.concatenate([self.known_ids, ids]), np.concatenate([self.lengths, lengths]), np.concatenate([self.used, np.zeros(len(gaps), np.int64)])
        self.tick += 1
        self.used[at] = self.tick
        return at

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each has."""
        whole = pc.match_substring_regex(texts, ODD_SPACE)
        for s in self.added:
            whole = pc.or_(whole, pc.match_substring(texts, s))
        cut = pc.split_pattern(pc.replace_substring(pc.if_else(whole, "", texts), "\n", " \n"), " ")
        first = cut.offsets.to_numpy()[:-1] - cut.offsets[0].as_py()
        flat = cut.flatten()
        coded = flat.dictionary_encode()
        which = self.places(coded.dictionary)[coded.indices.to_numpy()]
        # a text's first piece has no space before it; a text that goes whole is one such piece
        ids, lengths = self.ids(pc.if_else(whole, texts, flat.take(pa.array(first))).to_pylist())
        which[first] = len(self.lengths) + np.arange(len(first))
        lengths = np.concatenate([self.lengths, lengths])
        values = pa.LargeListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)]), pa.array(np.concatenate([self.known_ids, ids])))
        return values.take(pa.array(which)).flatten().to_numpy(), np.add.reduceat(lengths[which], first) if len(first) else np.empty(0, np.int64)


@lru_cache(maxsize=1)
def library_encoder(path: str) -> LibraryEncoder:
    """One for each worker process, so that what is remembered serves all of its tasks."""
    return LibraryEncoder(path)


def write_token_files(docs: DataFrame, folder: str, path: str | None = None, file_ids: int = FILE_IDS, blocks: int | None = None) -> None:
    """Write all documents' ids, each with the end id, as files in ``folder``."""
    path = path or default_vocabulary()
    schema = pa.schema([("content", pa.binary())])

    def put(block: int, part: int, doc_ids: list, ids: list) -> pa.RecordBatch:
        content = file_bytes(doc_ids, [len(i) + 1 for i in ids[::2]], np.concatenate(ids), block, part)  # each document's ids, then the end id
        return pa.RecordBatch.from_arrays([pa.array([content], pa.binary())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(path)
        end = np.array([END_ID], "<u4")
        block, part, size, doc_ids, ids = -1, 0, 0, [], []
        gc.disable()  # lists of many short-lived strings hold no cycles
        try:
            for batch in batches:
                for some in (batch.slice(i, 2500) for i in range(0, batch.num_rows, 2500)):
                    found, lengths = encoder.encode(some.column(3))
                    ends = np.cumsum(lengths)
                    for b, d, i, j in zip(some.column(0).to_pylist(), some.column(2).to_pylist(), (ends - lengths).tolist(), ends.tolist(), strict=True):
                        if doc_ids and (b != block or size >= file_ids):
                            yield put(block, part, doc_ids, ids)
                            part, size, doc_ids, ids = part + 1, 0, [], []
                        if b != block:
                            block, part = b, 0
                        doc_ids.append(d)
                        ids += [found[i:j], end]
                        size += j - i + 1
            if doc_ids:
                yield put(block, part, doc_ids, ids)
        finally:
            gc.enable()

    files = in_id_order(docs, False, blocks).mapInArrow(run, "content binary")
    # the text writer takes a string's bytes as they are
    files.select(F.col("content").cast("string")).write.option("maxRecordsPerFile", 1).text(folder)


def contents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("path string, modificationTime timestamp, length long, content binary").format("binaryFile").option("pathGlobFilter", "*.txt").load(folder).filter("length > 0").select("content")


def headers(spark: SparkSession, folder: str) -> DataFrame:
    """(block, part, n_docs, n_ids) of each file."""
    number = lambda at, size, kind: F.conv(F.hex(F.substring("content", at, size)), 16, 10).cast(kind)
    return contents(spark, folder).select(number(5, 4, "int").alias("block"), number(9, 4, "int").alias("part"), number(13, 8, "long").alias("n_docs"), number(21, 8, "long").alias("n_ids"))


def decoded(spark: SparkSession, folder: str) -> DataFrame:
    """Per document of the files: block, part, doc_id, at (ids before it in its file), n_tokens and ids (binary, little-endian unsigned 32-bit)."""
    schema = pa.schema([("block", pa.int32()), ("part", pa.int32()), ("doc_id", pa.int64()), ("at", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                raw = content.as_buffer()
                block, part = place(raw)
                doc_ids, lengths, _, _, ids = read_file(raw)
                ends = np.r_[0, np.cumsum(lengths)]
                # one buffer holds all ids; the offsets cut it into documents
                whole = pa.Array.from_buffers(pa.large_binary(), len(doc_ids), [None, pa.py_buffer(4 * ends), pa.py_buffer(ids.astype("<u4"))])
                columns = [pa.array([block] * len(doc_ids), pa.int32()), pa.array([part] * len(doc_ids), pa.int32()), pa.array(doc_ids, pa.int64()), pa.array(ends[:-1]), pa.array(lengths)]
                yield pa.RecordBatch.from_arrays([*columns, whole.cast(pa.binary())], schema=schema)

    return contents(spark, folder).mapInArrow(run, "block int, part int, doc_id long, at long, n_tokens long, ids binary")


def with_starts(rows: DataFrame, folder: str) -> DataFrame:
    """Rows of :func:`decoded` with ``start``, the ids of all documents before: their files' headers are counted and met by block and part.

    Where there are so many files that Spark does not broadcast them, the rows are shuffled: leave out ``ids`` if only a digest is wanted.
    """
    files = saved(headers(rows.sparkSession, folder), "token-files")
    # ids before a block: its window holds one row for each of a bounded number of blocks
    blocks = files.groupBy("block").agg(F.sum("n_ids").alias("n"))
    blocks = blocks.select("block", (F.sum("n").over(Window.orderBy("block")) - F.col("n")).alias("before"))
    parts = files.select("block", "part", (F.sum("n_ids").over(Window.partitionBy("block").orderBy("part")) - F.col("n_ids")).alias("inside"))
    starts = parts.join(blocks, "block").select("block", "part", (F.col("before") + F.col("inside")).alias("base"))
    return rows.join(starts, ["block", "part"]).withColumn("start", F.col("base") + F.col("at")).drop("block", "part", "base", "at")


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Per document: doc_id, start, n_tokens and ids, read from the files."""
    return with_starts(decoded(spark, folder), folder).select("doc_id", "start", "n_tokens", "ids")


def checksums(docs: DataFrame, path: str | None = None, file_ids: int = FILE_IDS, blocks: int | None = None) -> DataFrame:
    folder = scratch_path(docs.sparkSession, "tokens")
    write_token_files(docs, folder, path, file_ids, blocks)
    rows = decoded(docs.sparkSession, folder).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return with_starts(rows, folder).select("doc_id", "start", "n_tokens", "ids_crc32")


def op7_token_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checksums(table(spark, sf_dir, "documents"))
