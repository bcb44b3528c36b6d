"""Shared pieces: input tables, scratch tables on shared storage, id blocks and connected components."""

from __future__ import annotations

import math
import re
import tempfile
import uuid
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where none is set, a local session gets a folder of its own; a cluster is refused."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not known:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        known = "file://" + tempfile.mkdtemp(prefix="amalgam-")
        spark.sparkContext.setCheckpointDir(known)
    return known.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/amalgam/{name}-{uuid.uuid4().hex}"


#: Rows of a few numbers that a file of a scratch table holds.
ROWS_A_FILE = 250_000


def saved(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write to the shared folder and read again: cuts the lineage and survives lost executors.

    ``rows``: at most about how many narrow rows it has; the number of files then follows the data, not the shuffle setting.
    They are dealt out anew for it, so that the stage before keeps all of its tasks.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    if rows is not None:
        df = df.repartition(-(-rows // ROWS_A_FILE) or 1)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._amalgam_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Delete a table made by :func:`saved` that nothing reads any longer."""
    spark, path = df.sparkSession, getattr(df, "_amalgam_path", None)
    if path:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


#: Sampled ids for each block that is cut, and how much of a text tells the blocks of one id apart.
SAMPLED, LEAD = 100, 64


def number_list(values: list) -> str:
    return "array(" + ", ".join(f"{v}D" if isinstance(v, float) else f"{v}L" for v in values) + ")"


def block_of(column: Column, bounds: list) -> Column:
    """How many of the ascending bounds are at or below a number; null has block 0. Two short searches, however many bounds there are."""
    if not bounds:
        return F.lit(0)
    below = lambda known: F.coalesce(F.size(F.filter(known, lambda b: b <= column)), F.lit(0))
    width = math.isqrt(len(bounds) - 1) + 1
    if len(bounds) <= 64:
        return below(F.expr(number_list(bounds)))
    parts = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    inner = F.expr("array(" + ", ".join(map(number_list, parts)) + ")")
    first = below(F.expr(number_list([p[0] for p in parts])))
    return F.get(F.transform(F.array(first), lambda n: F.when(n > 0, (n - 1) * width + below(F.get(inner, n - 1))).otherwise(0)), 0)


#: Bytes of a block by Spark's estimate of the input's size, rows that a block has at least where that decides, and the most
#: blocks (their bounds are literals of a plan; larger blocks only take longer).
BLOCK_BYTES, BLOCK_ROWS, MOST_BLOCKS = 64 << 20, 1000, 1 << 16


def default_blocks(rows: DataFrame) -> int:
    """As many blocks as the input's size asks for (as far as its rows do), and four for each shuffle partition at least."""
    known = max(16, 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size // BLOCK_BYTES > known:  # the estimate may be far too high, or say that nothing is known
        known = max(known, min(size // BLOCK_BYTES, rows.count() // BLOCK_ROWS))
    return min(MOST_BLOCKS, known)


@dataclass
class Blocks:
    """Ranges of (id, text) of similar size. ``hot`` ids fill more than one, cut by the beginnings of their texts."""

    bounds: list[int]
    hot: dict[int, list[str]]

    def of(self, at: Column, text: Column) -> Column:
        block = block_of(at, self.bounds)
        if not self.hot:
            return block
        cuts = F.try_element_at(F.create_map(*[x for h, c in self.hot.items() for x in (F.lit(h), F.array(*map(F.lit, c)).cast("array<string>"))]), at)
        lead = F.substring(text, 1, LEAD)
        return block + F.when(at.isin(list(self.hot)), F.coalesce(F.size(F.filter(cuts, lambda c: c <= lead)), F.lit(0))).otherwise(0)


def cut_blocks(rows: DataFrame, blocks: int) -> Blocks:
    """Cut rows of (at, text) into about so many ranges, told by a sample of bounded size; it only balances tasks, results don't depend on it."""
    n = rows.count()
    some = rows.sample(SAMPLED * blocks / n, 1) if n > SAMPLED * blocks else rows
    shares = [i / blocks for i in range(1, blocks)]
    found = some.agg(F.percentile_approx("at", shares, max(10_000, 20 * blocks)).alias("q")).first()["q"] or []
    often = {h: k for h, k in Counter(found).items() if k > 1}
    hot = {}
    if often:
        leads = rows.filter(F.col("at").isin(list(often))).select("at", F.substring("text", 1, LEAD).alias("lead"))
        m = leads.count()
        leads = leads.sample(SAMPLED * sum(often.values()) / m, 1) if m > SAMPLED * sum(often.values()) else leads
        # as many beginnings as the sample's bound allows
        each = leads.groupBy("at").agg(F.sort_array(F.collect_list("lead")).alias("leads")).collect()
        hot = {r["at"]: sorted({r["leads"][len(r["leads"]) * i // often[r["at"]]] for i in range(1, often[r["at"]])}) for r in each}
    # the blocks of a hot id are counted before those of the ids after it
    after = [h + 1 for h, cuts in hot.items() if h < 2**63 - 1 for _ in cuts]
    return Blocks(sorted([*set(found), *after]), hot)


def connected_components(edges: DataFrame, rows: int, max_rounds: int = 50) -> DataFrame:
    """Smallest reachable node of every node with an edge, by alternating large-star and small-star steps.

    ``edges`` has long columns ``a`` and ``b``, about ``rows`` of them. Every round is two aggregations and two joins over edges that only
    shrink in number of distinct pairs; each round's edges are written to the shared folder. A hub is one row of ``lowest``, so its
    edges meet it by partial aggregation and a join that adaptive execution splits. It is over when every edge leads from a node
    without further edges to the root of its star. Returns (node, component).
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b"), F.col("a")))
        else:
            both = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        met = both.join(lowest, "u")
        if large:
            out = met.filter(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            out = met.select(F.col("v").alias("a"), F.col("m").alias("b")).union(lowest.select("u", "m"))
        return out.filter("a <> b").distinct()

    def unsettled(e: DataFrame) -> tuple[int, bool]:
        """Number of edges, and whether a node has two edges to smaller ones or stands between others."""
        ends = e.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(e.select("b", F.lit(0), F.lit(1)))
        each = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        n, open_ = each.agg(F.sum("up"), F.count_if((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0)))).first()
        return n or 0, bool(open_)

    now = saved(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges", rows)
    for _ in range(max_rounds):
        n, going = unsettled(now)
        if not going:
            break
        nxt = saved(star(star(now, True), False), "edges", n)
        dropped(now)
        now = nxt
    else:
        raise RuntimeError("connected components did not settle")
    part = now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).union(now.select(F.col("b"), F.col("b")).distinct())
    part._amalgam_path = now._amalgam_path  # for dropped(), once it has been read
    return part
