"""What a table of profiles holds, told by sketches that add up: distinct values and quantiles of confidence.

A bucket has one small row for each statistic: the number of values and a sketch of them. Sketches of buckets are united, so
the whole is told without reading profiles, and a bucket that changes is sketched anew by itself. Distinct values are HLL
sketches of 2^``LG_K`` registers (standard error 1.6 %), confidences a KLL sketch (rank error below 1 % for ``KLL_K``).
Partial sketches are built before any shuffle, so a hot bucket costs a task no more than the others.

Null fields and null elements count for nothing; a value held by several profiles is one. An empty table has no row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LG_K, KLL_K = 12, 400
#: How far an estimate may be off: three standard errors of a distinct count, and four times the rank error of a quantile.
DISTINCT_BOUND, RANK_BOUND = 0.05, 0.03
QUANTILES = (0.5, 0.9)
SCHEMA = "statistic string, n bigint, sketch binary"


def named_values() -> Column:
    """Every value that is counted, with its statistic's name."""
    values = {"candidates": F.array("candidate_id"), "emails": F.col("emails"), "phones": F.col("phones"), "skills": F.transform("skills", lambda s: s["name"])}
    each = lambda name, xs: F.transform(F.array_compact(xs), lambda x: F.struct(F.lit(name).alias("statistic"), x.alias("value")))
    return F.flatten(F.array_compact(F.array(*[each(name, xs) for name, xs in values.items()])))


def bucket_sketches(profiles: DataFrame) -> DataFrame:
    """(bucket, statistic, n, sketch) of profiles with their ``bucket``."""
    values = profiles.select("bucket", F.explode(named_values()).alias("v")).select("bucket", "v.*")
    distinct = values.groupBy("bucket", "statistic").agg(F.count("value").alias("n"), F.hll_sketch_agg("value", LG_K).alias("sketch"))
    known = profiles.filter("overall_confidence IS NOT NULL")
    confidence = known.groupBy("bucket").agg(F.lit("confidence").alias("statistic"), F.count("*").alias("n"), F.kll_sketch_agg_double("overall_confidence", KLL_K).alias("sketch"))
    return distinct.unionByName(confidence)


def estimates(sketches: DataFrame, quantiles: Sequence[float] = QUANTILES) -> DataFrame:
    """(statistic, n, estimate): distinct values, and ``confidence_pXX`` for each quantile, of all buckets' sketches."""
    distinct = sketches.filter("statistic <> 'confidence'").groupBy("statistic").agg(F.sum("n").alias("n"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).cast("double").alias("estimate"))
    united = sketches.filter("statistic = 'confidence'").groupBy("statistic").agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))
    asked = [F.struct(F.lit(f"confidence_p{q * 100:g}").alias("statistic"), F.kll_sketch_get_quantile_double("sketch", F.lit(float(q))).alias("estimate")) for q in quantiles]
    told = united.select("n", F.explode(F.array(*asked)).alias("q")).select("q.statistic", "n", "q.estimate") if asked else None
    return distinct if told is None else distinct.unionByName(told)
