"""Periodic runs: a document's word ids are compared with every shift of themselves, and long agreements are runs.

A run is a stretch of words of smallest period q that is at least three periods and 24 words long and that no neighbouring
word extends. At lag q it is a stretch of 2q agreements or more (16 at least), so among every fourth part of that many
words four neighbouring samples agree. Lags are scanned in octaves, many lags at once, on such samples; lags where four
neighbours agree are compared in full, their agreements run-length coded. No run is missed, and a scan costs n log n
comparisons. At a multiple of a run's period the run shows again: there the known one is blanked, and what is no known one is
tested for smaller periods directly.

Documents whose scan is long are dealt out: their word ids go with each range of lags to some task of the cluster, and the
runs found come together by document, which are fewer than its words. Other documents are scanned where they are read, so only the
long ones are shuffled.

Null and empty texts have no words and no runs; very long texts are read whole; documents are independent, so ties,
repeated rows and null doc_ids change nothing (the query plants no repetition in a row without doc_id); further columns,
whatever their names, are not read; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import as_strided
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from amalgam.llm.common import saved, table

EXPONENT, SHORTEST, SAMPLES = 3, 24, 4
#: Sampled comparisons of one task's range of lags, and how many are made at once.
WORK, AT_ONCE = 1 << 18, 1 << 20

Run = tuple[int, int, int]  # start, length, period


def word_ids(words: list[bytes]) -> np.ndarray:
    seen: dict[bytes, int] = {}
    return np.array([seen.setdefault(w, len(seen)) for w in words], np.int32)


def prime_factors(n: int) -> list[int]:
    found, p = [], 2
    while p * p <= n:
        if n % p == 0:
            found.append(p)
            while n % p == 0:
                n //= p
        p += 1
    return found + [n] * (n > 1)


def primitive(ids: np.ndarray, start: int, q: int) -> bool:
    """Whether the q words from ``start`` are no repetition of a shorter block."""
    block = ids[start : start + q]
    return not any(np.array_equal(block[q // p :], block[: q - q // p]) for p in prime_factors(q))


def agreements(same: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Starts and lengths of the stretches of at least so many true values."""
    ends = np.r_[-1, np.flatnonzero(~same), len(same)]
    sizes = np.diff(ends) - 1
    long = sizes >= least
    return list(zip((ends[:-1][long] + 1).tolist(), sizes[long].tolist(), strict=True))


def in_a_row(same: np.ndarray) -> np.ndarray:
    """Whether each row holds four neighbouring true values."""
    pairs = same[:, :-1] & same[:, 1:]
    return (pairs[:, :-2] & pairs[:, 2:]).any(axis=1)


def octaves(first: int, end: int) -> Iterator[tuple[int, int]]:
    while first < end:
        upto = min(end, max(16, 1 << first.bit_length()))
        yield first, upto
        first = upto


def runs_at(ids: np.ndarray, first: int, end: int, known: list[Run] = ()) -> list[Run]:
    """All runs whose period is at least ``first`` and below ``end``. ``known``: runs of smaller periods, as far as they are known."""
    n = len(ids)
    end = min(end, n // EXPONENT + 1)
    found: list[Run] = []
    by_period: dict[int, list[tuple[int, int]]] = {}
    for s, size, q in known:
        by_period.setdefault(q, []).append((s, size))
    for a, b in octaves(first, end):
        least = 2 * a if a >= 8 else 16  # agreements at any of these lags
        step = least // SAMPLES
        count = -(-(n - a) // step)
        if count < SAMPLES:
            continue
        at_once = max(1, AT_ONCE // count)
        padded = np.concatenate([ids, np.full(min(at_once, b - a) + step, -1, np.int32)])
        base = padded[: (count - 1) * step + 1 : step]
        for lag in range(a, b, at_once):
            lags = min(at_once, b - lag)
            m = -(-(n - lag) // step)
            if m < SAMPLES:
                break
            shifted = as_strided(padded[lag:], (lags, m), (padded.itemsize, step * padded.itemsize), writeable=False)
            same = shifted == base[:m]
            for row in np.flatnonzero(in_a_row(same)).tolist():
                q = lag + row
                least_here = max(SHORTEST - q, (EXPONENT - 1) * q)
                blanked = False
                for p, runs in by_period.items():
                    if q % p == 0:
                        for s, size in runs:
                            if size - q >= least_here:
                                same[row, -(-s // step) : -(-(s + size - q) // step)] = False
                                blanked = True
                if blanked and not in_a_row(same[row : row + 1])[0]:
                    continue
                for s, size in agreements(ids[q:] == ids[:-q], least_here):
                    if primitive(ids, s, q):
                        found.append((s, size + q, q))
                        by_period.setdefault(q, []).append((s, size + q))
    return found


def lag_ranges(n: int, work: int) -> list[tuple[int, int]]:
    """Ranges of lags of about so many sampled comparisons each: every octave takes about 2n."""
    out, first, room = [], 1, work
    for a, b in octaves(1, n // EXPONENT + 1):
        cost = 2 * n * (b - a) / a if a >= 16 else 4 * n
        if cost > work:
            parts = -(-int(cost) // work)
            edges = [a + (b - a) * i // parts for i in range(1, parts + 1)]
        else:
            edges = [b]
        for edge in edges:
            if cost / len(edges) > room and first < a:
                out.append((first, a))
                first, room = a, work
            room -= cost / len(edges)
            a = edge
    return [*out, (first, n // EXPONENT + 1)]


def summary(words: list[bytes], runs: list[Run]) -> tuple:
    """n_runs, the run of most periods, and the digests of all runs and of the words without what they repeat."""
    runs = sorted(runs, key=lambda r: (r[0], r[2]))
    best: Run | tuple = (None, None, None)
    drop = np.zeros(len(words) + 1, np.int32)
    for r in runs:
        if best[0] is None or r[1] * best[2] > best[1] * r[2]:
            best = r
        drop[r[0] + r[2]] += 1
        drop[r[0] + r[1]] -= 1
    kept = [w for w, d in zip(words, np.cumsum(drop).tolist(), strict=False) if not d] if runs else words
    told = "".join(f"{s},{size},{q}\n" for s, size, q in runs)
    exponent = None if best[0] is None else 1000 * best[1] // best[2]
    return len(runs), *best, exponent, hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest()


RESULT = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
RUNS = "starts array<long>, lengths array<long>, periods array<long>"
_LONGS, _L = pa.list_(pa.int64()), pa.int64()
RESULT_FIELDS = [("doc_id", _L), ("n_runs", _L), ("start", _L), ("length", _L), ("period", _L), ("exponent_milli", _L), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())]
RUN_FIELDS = [("starts", _LONGS), ("lengths", _LONGS), ("periods", _LONGS)]


def batch_of(rows: list[tuple], fields: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], schema=pa.schema(fields))


def apart(runs: list[Run]) -> tuple:
    return tuple(list(c) for c in zip(*runs, strict=True)) if runs else ([], [], [])


def scanned(docs: DataFrame, edit: Callable[[int | None, list[bytes]], list[bytes]] | None, work: int) -> DataFrame:
    """Results of the documents that are scanned at once; of each other one its words with the first range's runs, and its other ranges with its word ids."""
    fields = [("key", _L), *RESULT_FIELDS, *RUN_FIELDS, ("words", pa.binary()), ("ids", pa.binary()), ("first", _L), ("end", _L)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for batch in batches:
            for key, doc_id, text in zip(*batch.columns, strict=True):
                doc_id, key, words = doc_id.as_py(), key.as_py(), text.as_py().split()
                if edit:
                    words = edit(doc_id, words)
                ids = word_ids(words)
                (_, end), *others = lag_ranges(len(ids), work)
                runs = runs_at(ids, 1, end)
                if others:
                    out.append((key, doc_id, *[None] * 7, *apart(runs), b" ".join(words), None, None, None))
                    raw = ids.astype("<i4").tobytes()
                    size += 8 * len(raw)
                    for first, end in others:
                        # runs of fewer words hide no agreements at these lags
                        out.append((key, doc_id, *[None] * 7, *apart([r for r in runs if r[1] >= EXPONENT * first]), None, raw, first, end))
                        size += len(raw)
                else:
                    out.append((key, doc_id, *summary(words, runs), None, None, None, None, None, None, None))
                if len(out) >= 5000 or size > 32 << 20:
                    yield batch_of(out, fields)
                    out, size = [], 0
        if out:
            yield batch_of(out, fields)

    rows = docs.select(F.monotonically_increasing_id().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return saved(rows.mapInArrow(run, f"key long, {RESULT}, {RUNS}, words binary, ids binary, first long, end long"), "scanned")


def ranges_scanned(ranges: DataFrame) -> DataFrame:
    """The runs of each range of lags."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                key, raw, first, end, *known = (c[row].as_py() for c in batch.columns)
                runs = runs_at(np.frombuffer(raw, "<i4").astype(np.int32), first, end, list(zip(*known, strict=True)))
                yield batch_of([(key, *apart(runs))], [("key", _L), *RUN_FIELDS])

    dealt = ranges.select("key", "ids", "first", "end", "starts", "lengths", "periods").repartition("key", "first")
    return dealt.mapInArrow(run, f"key long, {RUNS}")


def summed_up(documents: DataFrame) -> DataFrame:
    """Results of documents whose runs of all ranges stand in their row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, words, *runs in zip(*batch.columns, strict=True):
                found = list(zip(*(c.as_py() for c in runs), strict=True))
                yield batch_of([(doc_id.as_py(), *summary(words.as_py().split(b" "), found))], RESULT_FIELDS)

    return documents.select("doc_id", "words", "starts", "lengths", "periods").mapInArrow(run, RESULT)


def periodic_runs(docs: DataFrame, edit: Callable[[int | None, list[bytes]], list[bytes]] | None = None, work: int = WORK) -> DataFrame:
    """One row a document, as :data:`RESULT` says. ``edit`` may change a document's words before the scan."""
    whole = scanned(docs, edit, work)
    done = whole.filter("n_runs is not null").select(*(n for n, _ in RESULT_FIELDS))
    long = whole.filter("words is not null")
    found = long.select("key", "starts", "lengths", "periods").union(ranges_scanned(whole.filter("ids is not null")))
    # the ranges of a document, and its runs, are fewer than its words
    gathered = found.groupBy("key").agg(*(F.flatten(F.collect_list(c)).alias(c) for c in ("starts", "lengths", "periods")))
    return done.union(summed_up(long.select("key", "doc_id", "words").join(gathered, "key")))


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The query's rule: in every tenth document (by checksum of the id) the words from one place on repeat the first few there."""
    if doc_id is None or not words:
        return words
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(table(spark, sf_dir, "documents"), planted)
