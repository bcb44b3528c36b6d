"""Importance resampling towards a target corpus: scores from hashed features, sorted runs, tournament merges.

Every document's words (or runs of several words) fall into buckets by CRC32; counts of all documents' and of the target's
features give each bucket a gain, an array that scores a document in one lookup. Gumbel noise from the document's id makes
the highest scores a weighted draw without replacement. Texts are read once: their bucket counts are written to the shared
folder, and both the corpus counts and the scores come from there.

The draw: each partition of scored rows is sorted and written, a run. Bounds from a bounded sample cut all runs into ranges of
the same keys, and each range's part of a run into blocks. A merge task gets a range's blocks in the order of their first
rows (Spark sorts them and spills where it must) and lets them into a tournament tree once the merge has come to their first
row, so that it holds one block of a run at most. Row counts of the ranges give every range its first rank; ranges after the
exact draw count are not merged, and the range in which the count is reached stops there.

Null texts have no features; empty texts neither, and weigh 0; very long texts are read whole and are one row of counts. Rows
without doc_id have the noise of an empty id and come before others of their score; of rows equal in score and doc_id that
with fewer features comes first, wholly equal ones in any order (each is a row of its own, and their ranks differ). Further
columns, whatever their names, are not read. Without eligible rows nothing is drawn; an empty table gives no row; with an
empty target all features are unseen there.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import chain, islice, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from amalgam.llm.bpe import Remembering
from amalgam.llm.common import dropped, saved, table

BUCKETS, LEAST_WORDS, PERCENT, SEED = 10_000, 20, 10, 2024
#: Rows of a range (more where there would be more ranges than the next figure), rows of a block, sampled rows for each bound.
RANGE_ROWS, MOST_RANGES, BLOCK_ROWS, SAMPLED = 16_384, 4096, 2048, 100
#: A-Z in lower case, every other ASCII byte but digits and letters a space; bytes of longer characters are parts of words.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
ROWS = "doc_id long, n_features long, weight long, score long"


def features(docs: DataFrame, runs: tuple[int, int] = (1, 1), buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, n_features and the buckets of each text's features with their counts (one bucket may be named twice)."""
    shortest, longest = runs
    ints = pa.list_(pa.int32())
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("buckets", ints), ("counts", ints)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Remembering(lambda feature: zlib.crc32(feature) % buckets)
        for batch in batches:
            for some in (batch.slice(i, 1000) for i in range(0, batch.num_rows, 1000)):
                words_of, found, times, ends = [], [], [], [0]
                for raw in some.column(1):
                    words = raw.as_py().translate(FOLD).split()
                    words_of.append(len(words))
                    each = Counter(words) if shortest == 1 else Counter()
                    for size in range(max(shortest, 2), longest + 1):
                        each.update(b" ".join(words[i : i + size]) for i in range(len(words) - size + 1))
                    found.extend(map(known.__getitem__, each))
                    times.extend(each.values())
                    ends.append(len(found))
                times = np.array(times, np.int32)
                total = np.r_[0, np.cumsum(times, dtype=np.int64)][ends]
                at = pa.array(ends, pa.int32())
                lists = [pa.ListArray.from_arrays(at, pa.array(v, pa.int32())) for v in (found, times)]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(words_of, pa.int64()), pa.array(np.diff(total)), *lists], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, buckets array<int>, counts array<int>")


def bucket_counts(found: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """How many features of all rows each bucket holds: each task adds its own into an array, the driver gets a row for each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(buckets, np.int64)
        for batch in batches:
            at, n = (c.flatten().to_numpy(zero_copy_only=False) for c in batch.columns)
            own += np.bincount(at, weights=n, minlength=buckets).astype(np.int64)
        there = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(own[there])], ["bucket", "n"])

    each = found.select("buckets", "counts").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = [0] * buckets
    for r in each.collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(own: list[int], target: list[int]) -> list[int]:
    """Thousandths of the logarithm by which each bucket is likelier in the target, smoothed by one in each bucket."""
    s_all, t_all, n = float(sum(own)), float(sum(target)), len(own)
    return [math.floor(1000 * math.log((t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n)))) for s, t in zip(own, target, strict=True)]


def noise(doc_id: int | None, seed: int) -> int:
    """A Gumbel variate in thousandths, from the id alone."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(found: DataFrame, gain: list[int], seed: int = SEED) -> DataFrame:
    """Each row's weight, the sum of its features' gains, and its score, the weight with noise."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worth = np.array(gain, np.int64)
        for batch in batches:
            ids, words, n, lists, counts = batch.columns
            each = worth[lists.flatten().to_numpy(zero_copy_only=False)] * counts.flatten().to_numpy(zero_copy_only=False)
            weight = np.diff(np.r_[0, np.cumsum(each)][lists.offsets.to_numpy() - lists.offsets[0].as_py()])
            chance = np.array([noise(i, seed) for i in ids.to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([ids, words, n, pa.array(weight), pa.array(weight + chance)], schema=schema)

    return found.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long, score long")


#: Rows in drawing order: a row's key is that of its columns, whatever stands before the semicolon descending.
KEY = ("k_score", "k_known", "k_id", "k_features", "k_salt")


def sorted_runs(rows: DataFrame, least_words: int) -> DataFrame:
    """Write each partition's rows in drawing order. A salt, written once, orders rows that agree in all else."""
    keyed = rows.select(
        "doc_id", "n_features", "weight", "score", (F.col("n_words") >= least_words).alias("eligible"), F.spark_partition_id().alias("run"),
        (-F.col("score")).alias("k_score"), F.col("doc_id").isNotNull().cast("long").alias("k_known"), F.coalesce("doc_id", F.lit(0)).alias("k_id"),
        F.col("n_features").alias("k_features"), F.xxhash64(F.monotonically_increasing_id()).alias("k_salt"),
    )
    return saved(keyed.sortWithinPartitions("eligible", *KEY), "runs")


def range_bounds(eligible: DataFrame, n: int, ranges: int) -> list[tuple]:
    """Keys that cut the rows into about so many ranges of similar size; they only balance tasks, results don't depend on them."""
    if ranges < 2:
        return []
    keys = eligible.select(*KEY)
    some = sorted(tuple(r) for r in (keys.sample(SAMPLED * ranges / n, 1) if n > SAMPLED * ranges else keys).collect())
    return sorted({some[len(some) * i // ranges] for i in range(1, ranges)}) if some else []


def cut_into_blocks(eligible: DataFrame, bounds: list[tuple], block_rows: int) -> DataFrame:
    """A row for each block: its range, its first row's key, and its rows' columns as arrays."""
    longs = pa.list_(pa.int64())
    names = ["doc_id", "n_features", "weight", "score", "k_salt"]
    schema = pa.schema([("range", pa.int32()), ("n", pa.int64()), *((k, pa.int64()) for k in KEY), *((f"{c}s", longs) for c in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in KEY), strict=True))
            own = batch.column("run").to_numpy()
            cuts = {0, len(keys), *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist()}
            # a part of a sorted run is sorted, so each bound within it is found by bisection
            for first, end in pairwise(sorted(cuts)):
                for b in bounds[bisect_right(bounds, keys[first]) : bisect_right(bounds, keys[end - 1])]:
                    cuts.add(bisect_left(keys, b, first, end))
            cuts = sorted({c for first, end in pairwise(sorted(cuts)) for c in range(first, end, block_rows)} | {len(keys)})
            if len(cuts) < 2:
                continue
            heads = [keys[c] for c in cuts[:-1]]
            at = pa.array(cuts, pa.int32())
            lists = [pa.ListArray.from_arrays(at, batch.column(c)) for c in names]
            columns = [pa.array([bisect_right(bounds, h) for h in heads], pa.int32()), pa.array(np.diff(cuts)), *(pa.array(k, pa.int64()) for k in zip(*heads, strict=True)), *lists]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    wanted = eligible.select("run", *KEY, "doc_id", "n_features", "weight", "score")
    lists = ", ".join(f"{c}s array<long>" for c in names)
    return wanted.mapInArrow(run, f"range int, n long, {', '.join(f'{k} long' for k in KEY)}, {lists}")


class Tournament:
    """A tree of matches: each leaf holds a block's current row, each inner node the leaf whose key is the smaller one.

    A block's next row replays the matches on its way up only. Freed leaves are used again; where none is free the tree doubles.
    """

    OVER = ((math.inf,), ())

    def __init__(self):
        self.size = 1
        self.heads, self.blocks, self.free = [self.OVER], [iter(())], [0]
        self.winner = [0, 0]

    def replay(self, leaf: int) -> None:
        node, winner, heads = (self.size + leaf) >> 1, self.winner, self.heads
        while node:
            a, b = winner[2 * node], winner[2 * node + 1]
            winner[node] = a if heads[a][0] <= heads[b][0] else b
            node >>= 1

    def enter(self, rows: Iterator[tuple]) -> None:
        if not self.free:
            old, self.size = self.size, 2 * self.size
            self.heads += [self.OVER] * old
            self.blocks += [iter(())] * old
            self.free = list(range(old, self.size))
            self.winner = [0] * self.size + list(range(self.size))
            for node in range(self.size - 1, 0, -1):
                a, b = self.winner[2 * node], self.winner[2 * node + 1]
                self.winner[node] = a if self.heads[a][0] <= self.heads[b][0] else b
        leaf = self.free.pop()
        self.blocks[leaf] = rows
        self.heads[leaf] = next(rows)
        self.replay(leaf)

    def head(self) -> tuple:
        return self.heads[self.winner[1]] if self.size > 1 else self.heads[0]

    def pop(self) -> tuple:
        leaf = self.winner[1] if self.size > 1 else 0
        row = self.heads[leaf]
        self.heads[leaf] = next(self.blocks[leaf], self.OVER)
        if self.heads[leaf] is self.OVER:
            self.blocks[leaf] = iter(())
            self.free.append(leaf)
        self.replay(leaf)
        return row


class Merge:
    """All rows of sorted blocks in order. The blocks come in the order of their first rows; each enters when the merge has come to it."""

    def __init__(self, blocks: Iterator[tuple[tuple, Iterator[tuple]]]):
        self.tree, self.blocks, self.waiting = Tournament(), blocks, next(blocks, None)

    def __iter__(self) -> Iterator[tuple]:
        while True:
            while self.waiting and self.waiting[0][0] <= self.tree.head()[0]:
                self.tree.enter(self.waiting[1])
                self.waiting = next(self.blocks, None)
            if self.tree.head() is self.tree.OVER:
                return
            yield self.tree.pop()

    def rest(self) -> Iterator[tuple]:
        """The rows that have not come yet, in any order and without further matches."""
        for head, rows in zip(self.tree.heads, self.tree.blocks, strict=True):
            if head is not self.tree.OVER:
                yield head
                yield from rows
        if self.waiting:
            yield from self.waiting[1]
        for _, rows in self.blocks:
            yield from rows


def ranked(blocks: DataFrame, first_ranks: dict[int, int], draws: int, tasks: int) -> DataFrame:
    """Rows of the ranges that hold draws, with ranks as far as the draw goes; behind it rows are passed on as they come."""
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "n_features", "weight", "score", "rank")])
    lists = ["k_salts", "doc_ids", "n_featuress", "weights", "scores"]

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for i in range(batch.num_rows):
                salts, ids, counts, weights, scores = (batch.column(c)[i].as_py() for c in lists)
                rows = [((-s, d is not None, d or 0, f, salt), (d, f, w, s)) for salt, d, f, w, s in zip(salts, ids, counts, weights, scores, strict=True)]
                yield batch.column("range")[i].as_py(), (rows[0], iter(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source = opened(batches)
        now = next(source, None)

        def of_range(which: int) -> Iterator[tuple]:
            nonlocal now
            while now and now[0] == which:
                block = now[1]
                now = next(source, None)
                yield block

        out: list[tuple] = []
        while now:
            first = first_ranks[now[0]]
            merge = Merge(of_range(now[0]))
            drawn = ((*row, first + i) for i, (_, row) in enumerate(islice(merge, draws - first), 1))
            for row in chain(drawn, ((*row, None) for _, row in merge.rest())):
                out.append(row)
                if len(out) >= 10_000:
                    yield batch_of(out)
                    out = []
        if out:
            yield batch_of(out)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=schema)

    dealt = blocks.repartition(tasks, "range").sortWithinPartitions("range", *KEY)
    return dealt.mapInArrow(run, f"{ROWS}, rank long")


def draw(rows: DataFrame, least_words: int = LEAST_WORDS, percent: int = PERCENT, range_rows: int = RANGE_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """All rows of :func:`scored`; those drawn have ranks 1, 2, 3 …, the others none."""
    runs = sorted_runs(rows, least_words)
    eligible = runs.filter("eligible")
    n = eligible.count()
    draws = n * percent // 100
    bounds = range_bounds(eligible, n, min(-(-n // range_rows), MOST_RANGES))
    blocks = saved(cut_into_blocks(eligible, bounds, block_rows), "blocks")
    first_ranks, before = {}, 0
    for r in sorted(blocks.groupBy("range").agg(F.sum("n").alias("n")).collect()):
        first_ranks[r["range"]] = before
        before += r["n"]
    last = max((r for r, first in first_ranks.items() if first < draws), default=-1)
    unranked = F.lit(None).cast("long").alias("rank")
    out = runs.filter("not eligible").select("doc_id", "n_features", "weight", "score", unranked)
    behind = blocks.filter(F.col("range") > last).select(F.inline(F.arrays_zip("doc_ids", "n_featuress", "weights", "scores")))
    out = out.union(behind.select("*", unranked))
    if last >= 0:
        out = out.union(ranked(blocks.filter(F.col("range") <= last), first_ranks, draws, last + 1))
    return out


def resampled(docs: DataFrame, target: DataFrame, runs: tuple[int, int] = (1, 1), buckets: int = BUCKETS, seed: int = SEED, **drawing) -> DataFrame:
    """Draw documents that look like the target's: every document's doc_id, n_features, weight, score and rank."""
    found = saved(features(docs, runs, buckets), "features")
    aim = bucket_counts(features(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), runs, buckets), buckets)
    out = draw(scored(found, gains(bucket_counts(found, buckets), aim), seed), **drawing)
    dropped(found)  # the runs are written
    return out


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
