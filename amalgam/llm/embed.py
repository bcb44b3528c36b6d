"""Embedding near-duplicates: random-hyperplane sign hashing in several tables, exact cosine, connected components.

Equal vectors of a label are one class from the start, named by a hash of their numbers and a sketch of 64 signs; a class
carries how many rows it has, so N copies cost N rows once and no comparison. Classes are hashed into several tables by
the signs of random projections. The number of signs follows from the distinct vectors of the largest label, so that only
a few chance mates share a bucket at any size; the number of tables follows from it and from ``miss``, the probability
with which a pair at the threshold itself may be missed (closer pairs are found more surely).

Buckets hold names and sketches alone. Inside a bucket classes whose sketches are near form groups; a group that comes up
in several tables is compared once, in the first of them. Only then are vectors fetched, one for each class of a group,
and every pair of a group is verified by cosine in double precision. A pair that meets in several tables counts in the
first of them only, so no pair list is kept: a group returns counts and links to one member of each linked part.

Vectors that are null, empty, zero or hold null or non-finite components, and rows with null label, link with nothing
and form their own component. Vectors of different length are never compared. Equal vectors (ties, repeated rows) are
different rows that link to each other; a repeated vec_id counts each of its rows, and each is kept if its vec_id names
the component. Null vec_id takes part without being a component's name. Further columns, whatever their names, are not
read. Vectors may be of any length. An empty table gives no row.

A bucket above ``block`` classes is dealt to parts, and each pair of parts is compared in a task of its own, so that no
task holds an unbounded bucket.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from amalgam.llm.common import connected_components, dropped, saved, table

THRESHOLD, MISS, BLOCK, SEED = 0.98, 4e-8, 2048, 7
SKETCH, MOST_TABLES = 64, 255
#: Groups up to this size are compared many at once, larger ones by a matrix product each.
SMALL = 32
#: Names a task remembers so as not to send copies again.
REMEMBERED = 200_000


@dataclass(frozen=True)
class Scheme:
    """How many signs name a bucket in how many tables, and how many of a sketch's signs may differ."""

    signs: int
    tables: int
    near: int
    threshold: float


def scheme(distinct: int, threshold: float = THRESHOLD, miss: float = MISS) -> Scheme:
    """For so many distinct vectors in the largest label: about four chance mates in a bucket."""
    agree = 1 - math.acos(threshold) / math.pi
    signs = min(62, max(6, round(math.log2(max(distinct, 1))) - 2))
    needed = lambda k: math.ceil(math.log(miss) / math.log1p(-min(agree**k, 1 - 1e-12)))
    while signs > 1 and needed(signs) > MOST_TABLES:
        signs -= 1
    above, near = 1.0, -1
    while above > miss and near < SKETCH:
        near += 1
        above -= math.comb(SKETCH, near) * (1 - agree) ** near * agree ** (SKETCH - near)
    return Scheme(signs, needed(signs), near, threshold)


@lru_cache(maxsize=8)
def planes(dim: int, n: int) -> np.ndarray:
    """The first ones of a fixed series of random hyperplanes."""
    return np.random.default_rng(SEED).standard_normal((n, dim)).T


def signs_of(units: np.ndarray, first: int, n: int) -> np.ndarray:
    return units @ planes(units.shape[1], first + n)[:, first:] >= 0


def codes_of(units: np.ndarray, s: Scheme) -> np.ndarray:
    """The code of every vector in every table."""
    weights = (1 << np.arange(s.signs)).astype(np.float64 if s.signs < 50 else np.int64)
    parts = [signs_of(units[i : i + 2000], SKETCH, s.tables * s.signs).reshape(-1, s.tables, s.signs) @ weights for i in range(0, len(units), 2000)]
    return np.concatenate(parts).astype(np.int64) if parts else np.empty((0, s.tables), np.int64)


def sketches_of(units: np.ndarray) -> np.ndarray:
    return np.packbits(signs_of(units, 0, SKETCH), axis=1).view(np.int64)[:, 0]


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (fixed multipliers of the splitmix generator)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def units_of(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def named(vectors: pa.Array, labels: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: places, numbers, unit vectors, names and sketches of the vectors that can link."""
    from xxhash import xxh3_64_intdigest

    size = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy().astype(np.int64)
    flat = pc.list_flatten(vectors)
    flat = pc.fill_null(flat, float("nan")).to_numpy()
    start = np.cumsum(size) - size
    label = pc.fill_null(labels, 0).to_numpy()
    has_label = labels.is_valid().to_numpy(zero_copy_only=False)
    for dim in np.unique(size[size > 0]):
        at = np.flatnonzero((size == dim) & has_label)
        x = flat[start[at][:, None] + np.arange(dim)] + flat.dtype.type(0)  # no negative zero
        own = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
        at, x = at[own], np.ascontiguousarray(x[own])
        if len(at):
            units = units_of(x)
            names = np.array([xxh3_64_intdigest(r.data, seed=int(k) & 0xFFFFFFFFFFFFFFFF) for r, k in zip(x, label[at])], np.uint64).view(np.int64)
            yield at, x, units, names, sketches_of(units)


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 4000) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


class Fresh:
    """Tells which names were not seen lately, so that copies leave a task once."""

    def __init__(self):
        self.seen: set[int] = set()

    def __call__(self, names: np.ndarray) -> np.ndarray:
        if len(self.seen) > REMEMBERED:
            self.seen.clear()
        out = np.zeros(len(names), bool)
        for i, x in enumerate(names.tolist()):
            if x not in self.seen:
                self.seen.add(x)
                out[i] = True
        return out


def rows_named(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, name, sketch) of every row; null name where the vector can't link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches):
            name, sketch, can = np.zeros(part.num_rows, np.int64), np.zeros(part.num_rows, np.int64), np.zeros(part.num_rows, bool)
            for at, _, _, names, sketches in named(part.column(2), part.column(1)):
                name[at], sketch[at], can[at] = names, sketches, True
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(name, mask=~can), pa.array(sketch, mask=~can)], names=["vec_id", "label", "name", "sketch"])

    return vectors.mapInArrow(run, "vec_id long, label long, name long, sketch long")


def placed(vectors: DataFrame, s: Scheme) -> DataFrame:
    """(bucket, name, sketch) in every table; the bucket's top byte tells the table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh = Fresh()
        tab = np.arange(s.tables, dtype=np.uint64)
        for part in pieces(batches):
            label = pc.fill_null(part.column(1), 0).to_numpy().view(np.uint64)
            for at, x, units, names, sketches in named(part.column(2), part.column(1)):
                own = fresh(names)
                if not own.any():
                    continue
                kind = mixed(label[at[own]] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(x.shape[1]))
                where = mixed(codes_of(units[own], s).view(np.uint64) + mixed(kind[:, None] + tab))
                bucket = ((tab ^ np.uint64(128)) << np.uint64(56)) | (where >> np.uint64(8))
                columns = bucket.ravel().view(np.int64), np.repeat(names[own], s.tables), np.repeat(sketches[own], s.tables)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["bucket", "name", "sketch"])

    return vectors.mapInArrow(run, "bucket long, name long, sketch long")


def united(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (of each place the first one of its part) once the parts of every a and b are one."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def steps(group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of places in the same group (sorted), those one apart first, then two apart and so on."""
    last = np.searchsorted(group, group, "right") - 1
    i, step = np.arange(len(group)), 1
    while len(i := i[last[i] >= i + step]):
        yield i, i + step
        step += 1


def grouped(s: Scheme, block: int):
    """(bucket, part, first, second, name, sketch) of every class that has a near sketch in its bucket.

    ``first`` and ``second`` name the group by its members, whatever the bucket. Rows arrive sorted by bucket and name.
    """
    schema = pa.schema([(c, pa.int32() if c == "part" else pa.int64()) for c in ("bucket", "part", "first", "second", "name", "sketch")])

    def told(bucket, part, first, second, name, sketch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((bucket, part, first, second, name, sketch), schema, strict=True)], schema=schema)

    def part_of(rows: np.ndarray, part: int) -> pa.RecordBatch:
        n = rows.shape[1]
        return told(rows[0], np.full(n, part), rows[0], np.zeros(n, np.int64), rows[1], rows[2])

    def near(rows: np.ndarray) -> pa.RecordBatch:
        bucket, name, sketch = rows
        label, bits = np.arange(len(bucket)), sketch.view(np.uint64)
        for i, j in steps(bucket):
            hit = np.bitwise_count(bits[i] ^ bits[j]) <= s.near
            if hit.any():
                label = united(label, i[hit], j[hit])
        own = np.bincount(label, minlength=len(label))[label] > 1
        signature = np.zeros((2, len(bucket)), np.uint64)
        each = mixed(name.view(np.uint64) ^ mixed(bits))
        np.add.at(signature[0], label[own], each[own])
        np.add.at(signature[1], label[own], mixed(each[own] + np.uint64(1)))
        first, second = signature.view(np.int64)[:, label[own]]
        return told(bucket[own], np.zeros(int(own.sum()), np.int32), first, second, name[own], sketch[own])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, dealt = np.empty((3, 0), np.int64), 0  # ``dealt``: parts of the last bucket that are out already

        def whole(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            """Buckets that are complete; of the first one ``dealt`` parts are out."""
            edges = np.r_[0, np.flatnonzero(np.diff(rows[0])) + 1, rows.shape[1]]
            large = [(a, b) for a, b in zip(edges[:-1], edges[1:]) if b - a > block or (a == 0 and dealt)]
            rest = np.ones(rows.shape[1], bool)
            for a, b in large:
                rest[a:b] = False
                for k, i in enumerate(range(a, b, block)):
                    yield part_of(rows[:, i : min(i + block, b)], k + (dealt if a == 0 else 0))
            if rest.any():
                yield near(rows[:, rest])

        for batch in batches:
            rows = np.concatenate([held, np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])], axis=1)
            if not rows.shape[1]:
                continue
            same = np.r_[False, (np.diff(rows) == 0).all(axis=0)]  # copies that several tasks sent
            rows = rows[:, ~same]
            tail = int(np.searchsorted(rows[0], rows[0, -1]))
            if tail:
                yield from whole(rows[:, :tail])
                dealt = 0
            held = rows[:, tail:]
            while held.shape[1] > block + 1:  # one stays to tell copies
                yield part_of(held[:, :block], dealt)
                held, dealt = held[:, block:], dealt + 1
        if held.shape[1]:
            yield from whole(held)

    return run


def compared(s: Scheme, kind: str):
    """(id, links counted here in rows, first id of its linked part here) for rows sorted by group."""
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("root", pa.int64())])

    def answer(group: np.ndarray, tab: np.ndarray, across: np.ndarray, side: np.ndarray, ids: np.ndarray, many: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        units = units_of(x)
        codes = codes_of(units, s)
        count, label = np.zeros(len(ids), np.int64), np.arange(len(ids))
        size = np.bincount(group)[group]
        few = np.flatnonzero(size <= SMALL)
        for i, j in steps(group[few]):
            i, j = few[i], few[j]
            linked = (np.einsum("ij,ij->i", units[i], units[j]) >= s.threshold) & (~across[i] | (side[i] != side[j]))
            i, j = i[linked], j[linked]
            if len(i):
                met = codes[i] == codes[j]
                now = met[np.arange(len(i)), tab[i]] & (met.argmax(axis=1) == tab[i])
                np.add.at(count, i[now], many[j[now]])
                np.add.at(count, j[now], many[i[now]])
                label = united(label, i, j)
        edges = np.flatnonzero(np.r_[True, np.diff(group) != 0, True])
        for a, b in zip(edges[:-1], edges[1:]):
            if b - a <= SMALL:
                continue
            t = tab[a]
            for i in range(a, b, 512):
                end = min(i + 512, b)
                linked = units[i:end] @ units[a:b].T >= s.threshold
                linked[np.arange(end - i), np.arange(i - a, end - a)] = False
                if across[a]:
                    linked &= side[i:end, None] != side[None, a:b]
                u, v = np.nonzero(linked)
                u, v = u + i, v + a
                label = united(label, u, v)
                now = codes[u, t] == codes[v, t]
                for k in range(t):
                    now &= codes[u, k] != codes[v, k]
                count[i:end] += np.bincount(u[now] - i, weights=many[v[now]], minlength=end - i).astype(np.int64)
        own = (count > 0) | (label != np.arange(len(ids)))
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (ids[own], count[own], ids[label[own]])], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(10)]  # dim, label, first, second, lo, hi, bucket, side, id, many
            raw = batch.column(10)
            edges = np.flatnonzero(np.r_[True, np.diff(columns[0]) != 0, True])
            for a, b in zip(edges[:-1], edges[1:]):  # runs of vectors of one length
                data = np.frombuffer(b"".join(v.as_buffer() for v in raw.slice(a, b - a)), kind).reshape(b - a, -1)
                some = ([c[a:b] for c in columns], data)
                if held is not None and held[0][0][0] != some[0][0][0]:
                    yield finished(*held)
                    held = None
                if held is not None:
                    some = ([np.concatenate(c) for c in zip(held[0], some[0])], np.concatenate([held[1], some[1]]))
                group = groups(some[0])
                tail = int(np.searchsorted(group, group[-1]))
                if tail:
                    yield finished([c[:tail] for c in some[0]], some[1][:tail])
                held = ([c[tail:] for c in some[0]], some[1][tail:])
        if held is not None:
            yield finished(*held)

    def groups(columns: list[np.ndarray]) -> np.ndarray:
        return np.cumsum(np.r_[False, np.any([np.diff(c) != 0 for c in columns[:6]], axis=0)])

    def finished(columns: list[np.ndarray], x: np.ndarray) -> pa.RecordBatch:
        *_, lo, hi, bucket, side, ids, many = columns
        tab = (bucket.view(np.uint64) >> np.uint64(56) ^ np.uint64(128)).astype(np.int64)
        return answer(groups(columns), tab, lo != hi, side, ids, many, x)

    return run


def fetched(vectors: DataFrame, wanted: DataFrame, dim_type: str) -> DataFrame:
    """(label, name, sketch, vec_id, dim, raw) once for each class in ``wanted`` (name, sketch)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh = Fresh()
        for part in pieces(batches):
            for at, x, _, names, sketches in named(part.column(2), part.column(1)):
                own = fresh(names)
                place = pa.array(at[own])
                raw = pa.array([r.tobytes() for r in x[own].astype(dim_type)], pa.binary())
                columns = [part.column(1).take(place), pa.array(names[own]), pa.array(sketches[own]), part.column(0).take(place), pa.array(np.full(int(own.sum()), x.shape[1], np.int32)), raw]
                yield pa.RecordBatch.from_arrays(columns, names=["label", "name", "sketch", "vec_id", "dim", "raw"])

    rows = vectors.mapInArrow(run, "label long, name long, sketch long, vec_id long, dim int, raw binary")
    return rows.join(wanted, ["name", "sketch"], "left_semi").dropDuplicates(["label", "name", "sketch"])


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, miss: float = MISS, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for a table of vec_id, embedding and label."""
    single = vectors.schema["embedding"].dataType.elementType.simpleString() == "float"
    kind = "<f4" if single else "<f8"
    source = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast(f"array<{'float' if single else 'double'}>"))
    n = vectors.count()
    rows = saved(rows_named(source), "vector-rows", n)
    own = ["label", "name", "sketch"]
    distinct = rows.groupBy("label").agg(F.approx_count_distinct("name").alias("n")).agg(F.max("n")).first()[0] or 0
    s = scheme(distinct, threshold, miss)
    copies = saved(rows.filter("name is not null").groupBy(own).agg(F.count("*").alias("many"), F.min("vec_id").alias("least")).filter("many > 1"), "vector-copies", n // 2)

    sent = placed(source, s).repartition("bucket").sortWithinPartitions("bucket", "name", "sketch")
    members = sent.mapInArrow(grouped(s, block), "bucket long, part int, first long, second long, name long, sketch long")
    # the lowest bucket is that of the first table in which the group comes up
    members = saved(members.groupBy("first", "second", "part", "name", "sketch").agg(F.min("bucket").alias("bucket")), "vector-groups", n)
    known = fetched(source, members.select("name", "sketch").distinct(), kind).join(copies, own, "left")
    known = known.select(F.monotonically_increasing_id().alias("id"), *own, F.coalesce("many", F.lit(1)).cast("long").alias("many"), F.coalesce("least", "vec_id").alias("least"), "dim", "raw")
    known = saved(known, "vectors", members.count())

    parts = members.groupBy("first", "second").agg((F.max("part") + 1).alias("parts")).filter("parts > 1")
    dealt = members.join(parts, ["first", "second"], "left").join(known.select("name", "sketch", "label", "dim", "id", "many", "raw"), ["name", "sketch"])
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    dealt = dealt.withColumn("lo", F.least("part", "other")).withColumn("hi", F.greatest("part", "other"))
    key = ["dim", "label", "first", "second", "lo", "hi"]
    dealt = dealt.select(*key, "bucket", F.col("part").alias("side"), "id", "many", "raw").repartition(*key).sortWithinPartitions(*key, "id")
    found = saved(dealt.mapInArrow(compared(s, kind), "id long, n long, root long"), "vector-links", known.count())

    part = connected_components(found.select(F.col("id").alias("a"), F.col("root").alias("b")), found.count())
    linked = known.select("id", *own, "many", "least").join(found.groupBy("id").agg(F.sum("n").alias("n")), "id").join(part, F.col("id") == part["node"])
    least = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    linked = linked.join(least, "component").select(*own, (F.col("n") + F.col("many") - 1).alias("n_links"), "component_id")
    alone = copies.join(linked, own, "left_anti").select(*own, (F.col("many") - 1).alias("n_links"), F.col("least").alias("component_id"))
    told = saved(linked.union(alone).withColumn("told", F.lit(True)), "vector-classes", n // 2)
    for t in (members, known, found, copies, part):
        dropped(t)
    out = rows.join(told, own, "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("told"), F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
