"""Times: versions as of a time, intervals that overlap, sessions, and rolling figures, without gathering a hot key in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def validity(versions: DataFrame, key: str, at: str, tie: str, span: str = "day") -> DataFrame:
    """Versions with ``valid_to``, when the next one of their key begins (null: still valid). Of versions of one time the last by ``tie`` holds.

    The next one is looked for within the ``span`` of time first; the last of a span gets the beginning of the key's next span of versions.
    """
    rows = versions.filter(F.col(at).isNotNull()).withColumn("_span", F.date_trunc(span, at))
    inside = F.lead(at).over(Window.partitionBy(key, "_span").orderBy(at, tie))
    firsts = rows.groupBy(key, "_span").agg(F.min(at).alias("_first"))
    firsts = firsts.select(F.col(key).alias("_key"), F.col("_span").alias("_of"), F.lead("_first").over(Window.partitionBy(key).orderBy("_span")).alias("_next"))
    met = rows.withColumn("_inside", inside).join(firsts, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_span") == F.col("_of")))
    met = met.withColumn("valid_to", F.coalesce("_inside", "_next")).filter(F.col("valid_to").isNull() | (F.col("valid_to") > F.col(at)))
    return met.select(*versions.columns, "valid_to")


def as_of(lookups: DataFrame, versions: DataFrame, key: str, at: str, tie: str, span: str = "day") -> DataFrame:
    """Each lookup with the version of its key that holds at its time (struct ``version``; null where none has begun).

    ``lookups`` and ``versions`` both have ``key`` and the timestamp ``at``; ``tie`` is a column of versions that orders those of one time. Both go
    into one union that is cut by key and ``span`` of time (a unit of date_trunc), so a hot key is as many groups as it has spans. A
    group's first rows may need a version of an earlier span: the last version of each span is carried over, one row a span.
    Lookups without a key or time have no version; versions without one say nothing.
    """
    known = versions.filter(F.col(key).isNotNull() & F.col(at).isNotNull())
    told = known.select(F.col(key).alias("_key"), F.col(at).alias("_at"), F.col(tie).alias("_tie"), F.struct(*versions.columns).alias("version"), F.lit(None).alias("_row"), F.lit(0).alias("_lookup"))
    asked = lookups.select(F.col(key).alias("_key"), F.col(at).alias("_at"), F.lit(None).alias("_tie"), F.lit(None).alias("version"), F.struct(*lookups.columns).alias("_row"), F.lit(1).alias("_lookup"))
    rows = told.union(asked).withColumn("_span", F.date_trunc(span, "_at"))
    # a null key or time would meet others in one group; such lookups go by themselves
    lost = rows.filter(F.col("_key").isNull() | F.col("_at").isNull())
    rows = rows.filter(F.col("_key").isNotNull() & F.col("_at").isNotNull())
    last = told.groupBy("_key", F.date_trunc(span, "_at").alias("_span")).agg(F.max_by("version", F.struct("_at", "_tie")).alias("_last"))
    # a version of any earlier span: the spans of lookups and of versions together, each once
    spans = rows.select("_key", "_span").distinct().join(last, ["_key", "_span"], "left")
    before = Window.partitionBy("_key").orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.select("_key", "_span", F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    inside = Window.partitionBy("_key", "_span").orderBy("_at", "_lookup", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    met = rows.withColumn("_inside", F.last("version", ignorenulls=True).over(inside)).filter("_lookup = 1")
    met = met.join(carried, ["_key", "_span"]).select("_row", F.coalesce("_inside", "_carried").alias("version"))
    return met.union(lost.select("_row", "version")).select("_row.*", "version")


def merged_intervals(rows: DataFrame, key: str, start: str, end: str, width: int = 12) -> DataFrame:
    """Whole-number intervals of a key that share a point as one each: (key, start, end, n). Intervals without bounds, or that end before they start, are left out.

    Merged within each ``width`` of starts first, so that a hot key is as many groups as its starts cover, and what is left again by key.
    """

    def merged(parts: DataFrame, by: list[str]) -> DataFrame:
        order = Window.partitionBy(*by).orderBy(start, end)
        reached = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
        islands = parts.withColumn("_new", F.when(reached >= F.col(start), 0).otherwise(1)).withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        return islands.groupBy(*by, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.sum("n").alias("n")).drop("_island")

    known = rows.filter(F.col(start) <= F.col(end)).select(key, start, end, F.lit(1).alias("n"), F.floor(F.col(start) / width).alias("_bucket"))
    return merged(merged(known, [key, "_bucket"]).drop("_bucket"), [key])


def overlapping(a: DataFrame, b: DataFrame, key: str, start: str, end: str, width: int) -> DataFrame:
    """Pairs (structs a and b) of one key whose whole-number intervals [start, end] share a point, each once.

    Intervals are put into every bucket of ``width`` that they touch and meet in a bucket of their key; a pair counts in the first
    bucket that both touch, so no distinct is needed. A key's intervals are dealt over its buckets, and the equality join over
    both is one that adaptive execution can split.
    """
    bucket = lambda c: F.floor(F.col(c) / width)
    put = lambda rows, name: rows.filter(F.col(start) <= F.col(end)).select(F.col(key).alias("_key"), F.explode(F.sequence(bucket(start), bucket(end))).alias("_bucket"), F.struct(*rows.columns).alias(name))
    met = put(a, "a").join(put(b, "b"), ["_key", "_bucket"])
    both = (F.col(f"a.{start}") <= F.col(f"b.{end}")) & (F.col(f"b.{start}") <= F.col(f"a.{end}"))
    first = F.greatest(F.floor(F.col(f"a.{start}") / width), F.floor(F.col(f"b.{start}") / width))
    return met.filter(both & (F.col("_bucket") == first)).select("a", "b")


def sessions(rows: DataFrame, key: str, at: str, gap: str, fields: str, names: list[str], tie: str, value: str, span: str = "day") -> DataFrame:
    """A key's submissions that follow each other within ``gap``: (key, started, ended, n, the last value of each field by name, by time and then tie).

    A stream needs a watermark on ``at``, and gives a session once nothing can be added to it. In a table a key's sessions are built within
    each ``span`` of time first, so that a hot key is as many groups as it has spans; sessions of neighbouring spans, a few
    rows, are then joined where they are within the gap. Rows without key or time belong to no session.
    """
    streams = rows.isStreaming
    known = rows.filter(F.col(key).isNotNull() & F.col(at).isNotNull())
    said = lambda f: F.max(F.when((F.col(fields) == f) & F.col(value).isNotNull(), F.struct(F.col(at).alias("at"), F.col(tie).alias("tie"), F.col(value).alias("value")))).alias(f)
    by = [F.col(key)] if streams else [F.col(key), F.date_trunc(span, at).alias("_span")]
    parts = known.groupBy(*by, F.session_window(at, gap).alias("_session")).agg(F.min(at).alias("started"), F.max(at).alias("ended"), F.count("*").alias("n"), *map(said, names))
    if not streams:
        order = Window.partitionBy(key).orderBy("started")
        new = F.when(F.col("started") <= F.lag("ended").over(order) + F.expr(f"INTERVAL {gap}"), 0).otherwise(1)
        parts = parts.withColumn("_new", new).withColumn("_island", F.sum("_new").over(order))
        parts = parts.groupBy(key, "_island").agg(F.min("started").alias("started"), F.max("ended").alias("ended"), F.sum("n").alias("n"), *(F.max(f).alias(f) for f in names))
    return parts.select(key, "started", "ended", "n", *(F.col(f)["value"].alias(f) for f in names))


def rolling(daily: DataFrame, key: str, day: str, value: str, days: int) -> DataFrame:
    """A day's figures with those of the last ``days`` days by RANGE (missing days count as nothing), the last known value before, and ranks with ties.

    ``daily`` has one row for each key and day (day as a whole number), so a window holds as many rows as there are days.
    """
    by_day = Window.partitionBy(key).orderBy(day)
    span = by_day.rangeBetween(1 - days, 0)
    before = F.last(value, ignorenulls=True).over(by_day.rowsBetween(Window.unboundedPreceding, -1))
    of_day = Window.partitionBy(day).orderBy(F.col(value).desc_nulls_last())
    return daily.select(
        "*", F.sum(value).over(span).alias("rolling"), F.count(value).over(span).alias("days_known"), before.alias("before"),
        F.rank().over(of_day).alias("rank"), F.dense_rank().over(of_day).alias("dense_rank"),
    )


def coverage(rows: DataFrame, by: list[str], key: str) -> DataFrame:
    """Rows and distinct keys for every combination of the columns and their totals, with the grouping id.

    Counted in two phases: rows are first counted by key and columns, which takes repeated ones away before the cube multiplies them.
    """
    each = rows.groupBy(*by, key).agg(F.count("*").alias("_n"))
    return each.cube(*by).agg(F.grouping_id().alias("grouping"), F.sum("_n").alias("n"), F.countDistinct(key).alias("keys"))
