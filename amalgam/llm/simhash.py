"""SimHash near-duplicates by anchor-point covering.

A fingerprint's two halves of 32 bits are covered by anchors: one free bit beside the perfect [31, 26] Hamming code, so
every half lies within one bit of an anchor (covering radius 1). Two fingerprints that differ in at most two bits differ
in at most one bit in one of the halves, so in that half both lie within radius + 1 = 2 bits of the first one's nearest
anchor. Each distinct fingerprint is therefore copied to all anchors within 2 bits of either half (at most 2 x 17), and
fingerprints are compared in full only under a common anchor. Nothing is probabilistic: no link is missed.

An anchor with many fingerprints is dealt to parts, and each pair of parts is compared in a task of its own.

Null and blank texts have fingerprint zero and link like any other; very long texts are read whole. Equal fingerprints (ties,
repeated rows) fall together before any comparison. Rows without doc_id keep their group's component, which is the smallest
doc_id of the group (null if none has one). Of a group :func:`kept_rows` keeps one row. Further columns, whatever their names,
are kept there and not read otherwise. An empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from amalgam.llm.common import connected_components, dropped, saved, table

SHINGLE, SEED, THRESHOLD = 3, 42, 2
#: Above this many fingerprints under one anchor, neighbours are looked up bit by bit instead of compared pair by pair.
PAIRWISE = 4096
#: Fingerprints under one anchor that a task holds; larger groups are dealt to parts, and each pair of parts is a task's.
MOST = 65_536


def fingerprint(text: str | None) -> int:
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()  # of bytes: lower() and split() know ASCII only
    if not words:
        return 0
    if len(words) < SHINGLE:
        hashes = [xxh64_intdigest(b" ".join(words), SEED)]
    else:
        hashes = [xxh64_intdigest(s, SEED) for s in map(b" ".join, zip(words, words[1:], words[2:]))]
    bits = np.unpackbits(np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return int.from_bytes(np.packbits(bits.sum(axis=0, dtype=np.uint32) * 2 > len(hashes)).tobytes(), "big")


def with_fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, fp): a digest of the text, and the fingerprint's 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py()) for t in batch.column(2)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps.view(np.int64))], names=["doc_id", "digest", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("digest"), "text").mapInArrow(run, "doc_id long, digest long, fp long")


def hamming_flips() -> tuple[np.ndarray, np.ndarray]:
    """For each syndrome: the flip to the nearest codeword, and the 15 two-bit flips to the codewords at distance two."""
    bit = lambda i: np.uint64(1) << np.uint64(i - 1)
    near = np.array([0, *(bit(s) for s in range(1, 32))], dtype=np.uint64)
    far = np.zeros((32, 15), dtype=np.uint64)
    for s in range(1, 32):
        far[s] = [bit(i) | bit(i ^ s) for i in range(1, 32) if i < i ^ s and i != s]
    return near, far


def anchors(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (anchor, fingerprint) rows of these fingerprints."""
    near, far = hamming_flips()
    at, who = [], []
    for half in (0, 1):
        word = (fps >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)
        free, code = word >> np.uint64(31), word & np.uint64(0x7FFFFFFF)
        syndrome = np.zeros(len(fps), dtype=np.uint64)
        for i in range(1, 32):
            syndrome ^= np.uint64(i) * ((code >> np.uint64(i - 1)) & np.uint64(1))
        s = syndrome.astype(np.int64)
        home = code ^ near[s]
        places = np.concatenate([np.stack([home | free << np.uint64(31), home | (free ^ np.uint64(1)) << np.uint64(31)], 1), (code[:, None] ^ far[s]) | (free << np.uint64(31))[:, None]], 1)
        real = np.ones(places.shape, dtype=bool)
        real[s == 0, 2:] = False  # a codeword has no other codeword within two bits
        at.append((places | np.uint64(half << 32))[real])
        who.append(np.broadcast_to(fps[:, None], places.shape)[real])
    return np.concatenate(at), np.concatenate(who)


def star_links(fps: np.ndarray) -> np.ndarray:
    """Index of the first member of each fingerprint's linked group, among distinct sorted fingerprints."""
    n = len(fps)
    label = np.arange(n)
    flips = None
    if n > PAIRWISE:
        one = [1 << i for i in range(64)]
        flips = np.array([*one, *(a | b for i, a in enumerate(one) for b in one[:i])], dtype=np.uint64)
    while True:
        new = label.copy()
        if flips is None:
            for i in range(0, n, 512):
                near = np.bitwise_count(fps[i : i + 512, None] ^ fps[None, :]) <= THRESHOLD
                new[i : i + 512] = np.where(near, label[None, :], n).min(axis=1)
        else:
            for f in flips:
                j = np.minimum(np.searchsorted(fps, fps ^ f), n - 1)
                hit = fps[j] == fps ^ f
                new[hit] = np.minimum(new[hit], label[j[hit]])
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


LINKS, NONE = "a long, b long, part int", np.empty(0, np.uint64)


def star_batch(groups: list[np.ndarray], a: np.ndarray = NONE, b: np.ndarray = NONE) -> pa.RecordBatch:
    """Star links of groups of distinct sorted fingerprints, after the links (a, b)."""
    a, b = [a], [b]
    for group in groups:
        root = star_links(group)
        own = root != np.arange(len(group))
        a.append(group[own])
        b.append(group[root[own]])
    links = [pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)]
    return pa.RecordBatch.from_arrays([*links, pa.array(np.full(len(links[0]), -1, np.int32))], names=["a", "b", "part"])


def grouped_links(most: int):
    """Star links of each anchor's fingerprints; rows arrive sorted by anchor.

    An anchor with more than ``most`` fingerprints is not held: its (anchor, fingerprint) rows go on with the number of their part.
    """

    def dealt(anchor: int, fps: list[np.ndarray], part: int) -> pa.RecordBatch:
        whole = np.concatenate(fps)
        columns = pa.array(np.full(len(whole), anchor, np.int64)), pa.array(whole.view(np.int64)), pa.array(np.full(len(whole), part, np.int32))
        return pa.RecordBatch.from_arrays(columns, names=["a", "b", "part"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, last, part = [], 0, None, 0  # the last anchor's fingerprints so far, and how many parts of it went on
        for batch in batches:
            at, fps = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            if not len(at):
                continue
            edges = np.r_[0, np.flatnonzero(at[1:] != at[:-1]) + 1, len(at)]
            first = int(at[0] == last)
            if first:
                held.append(fps[: edges[1]])
                n += int(edges[1])
            if len(edges) - 1 > first:  # the last anchor's group is over, others are whole, and the batch's last one may go on
                groups = [np.sort(np.concatenate(held))] if n > 1 and not part else []
                if part and n:
                    yield dealt(last, held, part)
                starts, sizes = edges[first:-2], np.diff(edges[first:-1])
                two = starts[sizes == 2]
                two = two[np.bitwise_count(fps[two] ^ fps[two + 1]) <= THRESHOLD]
                groups += [np.sort(fps[i : i + k]) for i, k in zip(starts[sizes > 2], sizes[sizes > 2], strict=True)]
                yield star_batch(groups, np.maximum(fps[two], fps[two + 1]), np.minimum(fps[two], fps[two + 1]))
                held, n, last, part = [fps[edges[-2] :]], len(at) - int(edges[-2]), at[-1], 0
            if n > most:
                yield dealt(last, held, part)
                held, n, part = [], 0, part + 1
        if part and n:
            yield dealt(last, held, part)
        elif n > 1:
            yield star_batch([np.sort(np.concatenate(held))])

    return run


def paired_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Star links of each pair of parts of an anchor; rows (anchor, lo, hi, fp) arrive sorted."""
    held, key = [], None
    for batch in batches:
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
        edges = np.flatnonzero(np.r_[True, np.any([np.diff(c) != 0 for c in columns[:3]], axis=0), True])
        for i, j in zip(edges[:-1], edges[1:]):
            own = tuple(c[i] for c in columns[:3])
            if own != key and held:
                yield star_batch([np.unique(np.concatenate(held))])
                held = []
            key = own
            held.append(columns[3][i:j].view(np.uint64))
    if held:
        yield star_batch([np.unique(np.concatenate(held))])


def fingerprint_links(fps: DataFrame, most: int = MOST) -> DataFrame:
    """Star links (a, b) between distinct fingerprints at two or fewer differing bits."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, who = anchors(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(at.view(np.int64)), pa.array(who.view(np.int64))], names=["anchor", "fp"])

    placed = fps.mapInArrow(spread, "anchor long, fp long").repartition("anchor").sortWithinPartitions("anchor")
    found = saved(placed.mapInArrow(grouped_links(most), LINKS), "simhash-links", fps.count())
    links = found.filter("part < 0").select("a", "b")
    path = found._amalgam_path
    large = found.filter("part >= 0")
    if large.isEmpty():
        links._amalgam_path = path  # for dropped(), once they have been read
        return links
    parts = large.groupBy("a").agg((F.max("part") + 1).alias("parts"))
    dealt = large.join(parts, "a").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select(F.col("a").alias("anchor"), F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), F.col("b").alias("fp"))
    key = ["anchor", "lo", "hi"]
    more = dealt.repartition(*key).sortWithinPartitions(*key).mapInArrow(paired_links, LINKS)
    links = links.union(more.select("a", "b"))
    links._amalgam_path = path
    return links


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, digest, fp) of every row, and (fp, first, component) of every fingerprint: ``first`` is its smallest row's doc_id and digest."""
    rows = saved(with_fingerprints(docs), "simhash", docs.count())
    # of a group's rows that with the smallest doc_id comes first, none last, then that of the smallest digest; n rows are alike in both
    each = rows.groupBy("fp", F.col("doc_id").isNull().alias("none"), "doc_id", "digest").agg(F.count("*").alias("n"))
    each = saved(each.groupBy("fp").agg(F.min(F.struct("none", "doc_id", "digest", "n")).alias("first")), "simhash-fp", rows.count())
    n = each.count()
    links = fingerprint_links(each.select("fp"))
    part = connected_components(links, n)
    named = each.join(part, each["fp"] == part["node"], "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    named = saved(named, "simhash-class", n)
    for t in (links, part, each):
        dropped(t)
    return rows, named


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) of every row."""
    rows, named = classes(docs)
    least = named.groupBy("component").agg(F.min("first")["doc_id"].alias("component_id"))
    return rows.join(named.join(least, "component").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def hashable(docs: DataFrame, prefix: str = "") -> list[Column]:
    """All columns; those that hold maps or variants, which have no hash, as JSON."""
    unhashed = lambda kind: "map<" in kind or "variant" in kind
    columns = [(kind, F.col(prefix + quoted(name))) for name, kind in docs.dtypes]
    return [F.to_json(F.struct(c.alias("v"))) if unhashed(kind) else c for kind, c in columns]


def kept_rows(docs: DataFrame) -> DataFrame:
    """One row of each group, with all its columns: that with the smallest doc_id (none last), text digest and hash of its columns.

    The texts are shuffled once at most; not if the kept ids fit a broadcast, but for rows that repeat a kept doc_id and its text.
    """
    rows, named = classes(docs)
    dropped(rows)
    first = named.groupBy("component").agg(F.min("first").alias("first")).select(F.col("first.doc_id").alias("_kept_doc"), F.col("first.digest").alias("_kept_digest"), F.col("first.n").alias("_kept_n"))
    first = saved(first, "simhash-kept", named.count())
    once, often = first.filter("_kept_n = 1"), first.filter("_kept_n > 1")
    own = lambda kept: [docs["doc_id"].cast("long").eqNullSafe(kept["_kept_doc"]), F.xxhash64(docs["text"]) == kept["_kept_digest"]]
    alone = docs.join(once, own(once), "left_semi")
    if often.isEmpty():
        return alone
    alike = docs.join(often, own(often)).select(often["_kept_doc"], often["_kept_digest"], F.struct(*[docs[quoted(c)] for c in docs.columns]).alias("row"))
    one = alike.groupBy("_kept_doc", "_kept_digest").agg(F.min_by("row", F.xxhash64(*hashable(docs, "row."))).alias("row"))
    return alone.union(one.select("row.*"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
