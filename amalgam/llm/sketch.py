"""Document fingerprints: an invertible Bloom lookup sketch over hashed paragraph cells.

A text is cut into paragraphs: at line ends and sentence ends, and long ones further into runs of 16 words (or of 200
characters where there are no spaces). The k-th occurrence of a paragraph has a digest of its own, so repeats count. Each
digest is put into three cells (count, XOR of digests, XOR of checks). Subtracting two texts' sketches cancels what they
share; peeling cells that hold one digest recovers the digests that differ. Where that fails, both texts are sketched
again with more cells, until it succeeds. The likeness of two texts is the share of their paragraphs (as a multiset) that
they have in common; that of two empty texts is 1.

The fingerprint names the number of paragraphs and holds the smallest sketch, so equal texts have equal fingerprints.

Null texts count as empty; very long texts are read whole; further columns, whatever their names, are not read; an empty
table gives no row. Documents are dealt in blocks of ascending doc_id, each block also getting the first document of the
next, so that every text is shuffled once; rows without doc_id come first, repeated doc_ids are ordered by text (ties
between equal rows change nothing). An id that many rows have (or lack) is cut into blocks of its own by the beginnings of
its texts; only rows that agree in id and the first 64 characters stay in one block.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from amalgam.llm.common import cut_blocks, default_blocks, table

CELLS, HASHES = 24, 3
LONG, RUN, CUT = 200, 16, 200
CELL = np.dtype([("count", "<i4"), ("digests", "<u8"), ("checks", "<u4")])


def paragraphs(text: str) -> list[str]:
    found = []
    for p in text.replace(". ", ".\n").replace("! ", "!\n").replace("? ", "?\n").split("\n"):
        if len(p) <= LONG:
            if p:
                found.append(p)
            continue
        words = p.split(" ")
        for i in range(0, len(words), RUN):
            run = " ".join(words[i : i + RUN])
            if len(run) <= 2 * CUT:
                found.append(run)
            else:
                found.extend(run[k : k + CUT] for k in range(0, len(run), CUT))
    return found


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (fixed multipliers of the splitmix generator)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def digests(text: str | None) -> np.ndarray:
    """A 64-bit digest of each paragraph; later occurrences of one have other digests."""
    from xxhash import xxh3_64_intdigest

    keys = np.sort(np.array([xxh3_64_intdigest(p) for p in paragraphs(text or "")], dtype=np.uint64))
    if len(keys) > 1:
        new = np.r_[True, keys[1:] != keys[:-1]]
        if not new.all():
            starts = np.flatnonzero(new)
            nth = np.arange(len(keys)) - np.repeat(starts, np.diff(np.r_[starts, len(keys)]))
            keys = np.where(nth > 0, mixed(keys + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), keys)
    return keys


def checks(keys: np.ndarray) -> np.ndarray:
    return (mixed(keys ^ np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)).astype(np.uint32)


def places(keys: np.ndarray, cells: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The three cells of each digest in a sketch of so many cells (a multiple of 3) that starts ``at``."""
    third = (cells // HASHES).astype(np.uint64)
    seeds = np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)
    return np.concatenate([at + (mixed(keys + seed + third) % third).astype(np.int64) + j * third.astype(np.int64) for j, seed in enumerate(seeds)])


def sketches(keys: list[np.ndarray], cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sketches of several key sets one after another, and where each starts."""
    at = np.r_[0, np.cumsum(cells)]
    out = np.zeros(at[-1], CELL)
    n = [len(k) for k in keys]
    flat = np.concatenate(keys) if keys else np.empty(0, np.uint64)
    if len(flat):
        where = places(flat, np.repeat(cells, n), np.repeat(at[:-1], n))
        counts, xors, sums = (np.zeros(at[-1], t) for t in (np.int32, np.uint64, np.uint32))
        np.add.at(counts, where, np.int32(1))
        np.bitwise_xor.at(xors, where, np.tile(flat, HASHES))
        np.bitwise_xor.at(sums, where, np.tile(checks(flat), HASHES))
        out["count"], out["digests"], out["checks"] = counts, xors, sums
    return out, at


def subtracted(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros(len(a), CELL)
    out["count"], out["digests"], out["checks"] = a["count"] - b["count"], a["digests"] ^ b["digests"], a["checks"] ^ b["checks"]
    return out


def peeled(cells: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Peel all subtracted sketches at once: owner and digest of what differs, and which sketches came out whole."""
    count, keys, sums = cells["count"].copy(), cells["digests"].copy(), cells["checks"].copy()
    sizes = np.diff(at)
    owners, found = [], []
    live = np.flatnonzero(count)
    while len(live):
        pure = live[(np.abs(count[live]) == 1) & (sums[live] == checks(keys[live]))]
        if not len(pure):
            break
        who = np.searchsorted(at, pure, "right") - 1
        order = np.lexsort((keys[pure], who))
        pure, who = pure[order], who[order]
        first = np.r_[True, (who[1:] != who[:-1]) | (keys[pure][1:] != keys[pure][:-1])]
        pure, who = pure[first], who[first]
        k, sign = keys[pure], count[pure]
        owners.append(who)
        found.append(k)
        where = places(k, sizes[who], at[who])
        np.subtract.at(count, where, np.tile(sign, HASHES))
        np.bitwise_xor.at(keys, where, np.tile(k, HASHES))
        np.bitwise_xor.at(sums, where, np.tile(checks(k), HASHES))
        live = np.unique(where)
        live = live[count[live] != 0]
    left = (count != 0) | (keys != 0)
    whole = ~np.logical_or.reduceat(left, at[:-1]) if len(sizes) else np.empty(0, bool)
    return np.concatenate([np.empty(0, np.int64), *owners]), np.concatenate([np.empty(0, np.uint64), *found]), whole


def differing(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    """For each pair of key sets the digests in one of the two only, from subtracted sketches of growing size."""
    out: list = [None] * len(a)
    todo, cells = np.arange(len(a)), np.full(len(a), CELLS)
    while len(todo):
        (x, at), (y, _) = (sketches([s[i] for i in todo], cells) for s in (a, b))
        diff = subtracted(x, y)
        owners, found, whole = peeled(diff, at)
        order = np.argsort(owners, kind="stable")
        parts = np.split(found[order], np.searchsorted(owners[order], np.arange(1, len(todo))))
        for k in np.flatnonzero(whole):
            out[todo[k]] = np.sort(parts[k])
        empty = np.add.reduceat(diff["count"] == 0, at[:-1]) / cells
        most = np.array([len(a[i]) + len(b[i]) for i in todo])
        # as many cells as the share of empty ones suggests; where none is empty, enough for all digests
        guess = np.where(empty > 0, -np.log(np.maximum(empty, 1e-9)) * cells / HASHES, most)
        larger = np.maximum(2 * cells, (1.4 * np.minimum(guess, most)).astype(np.int64) + CELLS)
        todo, cells = todo[~whole], (larger[~whole] + HASHES - 1) // HASHES * HASHES
    return out


def likeness(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    n = np.array([len(x) + len(y) for x, y in zip(a, b, strict=True)], dtype=np.float64)
    d = np.array([len(x) for x in differing(a, b)], dtype=np.float64)
    return np.where(n > 0, (n - d) / np.maximum(n + d, 1), 1.0)


def fingerprints(keys: list[np.ndarray]) -> list[str]:
    cells, at = sketches(keys, np.full(len(keys), CELLS))
    return [f"{len(k)}:{base64.b64encode(cells[i:j].tobytes()).decode()}" for k, i, j in zip(keys, at[:-1], at[1:], strict=True)]


def edited(text: str, following: str) -> str:
    """The text with its last quarter replaced by the start of the following document."""
    q = len(text) // 4
    return text[: len(text) - q] + following[:q]


def in_id_order(docs: DataFrame, guests: bool, blocks: int | None = None) -> DataFrame:
    """Documents in blocks of ascending (doc_id, text), sorted; with ``guests`` each block ends with the next block's first one."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("at", F.coalesce("doc_id", F.lit(-(2**63))))
    blocks = blocks or default_blocks(rows)
    cut = cut_blocks(rows.select("at", "text"), blocks)
    rows = rows.withColumn("block", cut.of(F.col("at"), F.col("text")))
    order = ["block", "at", "text"]
    if guests:
        # at most one row for each of the blocks, so both the window and the broadcast are bounded
        heads = rows.groupBy("block").agg(F.min("at").alias("head"))
        by_block = Window.orderBy("block")
        last = F.last("block").over(by_block.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        heads = heads.select("block", "head", F.coalesce(F.lag("block").over(by_block), last).alias("to"))
        is_hot = F.col("head").isin(list(cut.hot))
        plain = heads.filter(~is_hot).select("head", "to") if cut.hot else heads.select("head", "to")
        met = rows.join(F.broadcast(plain), rows["at"] == plain["head"], "left")
        goes = F.array(F.struct("block", F.lit(0).alias("guest")), F.struct(F.col("to").alias("block"), F.lit(1).alias("guest")))
        met = met.withColumn("goes", F.when(F.col("to").isNull(), F.slice(goes, 1, 1)).otherwise(goes)).select("doc_id", "text", "at", F.inline("goes"))
        if cut.hot:
            # of an id that fills several blocks only the first text of a block is a guest
            first = rows.filter(F.col("at").isin(list(cut.hot))).groupBy("block").agg(F.min("text").alias("text"))
            first = first.join(F.broadcast(heads.filter(is_hot)), "block").select(F.nullif("head", F.lit(-(2**63))).alias("doc_id"), "text", F.col("head").alias("at"), F.col("to").alias("block"), F.lit(1).alias("guest"))
            met = met.unionByName(first)
        rows = met
        order.insert(1, "guest")
    else:
        rows = rows.withColumn("guest", F.lit(0))
    # as many tasks as blocks ask for, whatever the shuffle setting
    return rows.repartition(-(-blocks // 4), "block").sortWithinPartitions(*order).select("block", "guest", "doc_id", "text")


def version_fingerprints(docs: DataFrame, batch_rows: int = 400, blocks: int | None = None) -> DataFrame:
    """Fingerprints of every document and of its edited text, and its likeness to that and to the next document."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def answer(pairs: list[tuple]) -> pa.RecordBatch:
        texts = [p[1] for p in pairs]
        changed = [edited(t, n) for _, t, n in pairs]
        own, other = [digests(t) for t in texts], [digests(t) for t in changed]
        # a pair's next text is mostly the text of the pair after it
        following = [own[i + 1] if i + 1 < len(pairs) and texts[i + 1] is n else digests(n) for i, (_, _, n) in enumerate(pairs)]
        columns = [[p[0] for p in pairs], [len(t) for t in texts], [hashlib.sha256(t.encode()).hexdigest() for t in changed], fingerprints(own), fingerprints(other), likeness(own, other), likeness(own, following)]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: list[tuple] = []
        held = None  # the last document, which waits for the next one's text
        for batch in batches:
            for block, guest, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[0] == block:
                    pairs.append((held[1], held[2], text))
                held = None if guest else (block, doc_id, text)
                if len(pairs) >= batch_rows:
                    yield answer(pairs)
                    pairs = []
        if pairs:
            yield answer(pairs)

    return in_id_order(docs, True, blocks).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return version_fingerprints(table(spark, sf_dir, "documents"))
