"""Queries over a store that is saved to and read back, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from amalgam.operators.scratch import scratch_path
from amalgam.operators.sketches import DISTINCT_BOUND, QUANTILES, RANK_BOUND
from amalgam.operators.store import CandidateStore
from amalgam.plans import inputs as I
from amalgam.plans.queries import SUMMARY, query, scored

#: Profiles are saved in two parts, by whether their number is even.
AT = ("2026-01-01 00:00:00", "2026-02-01 00:00:00")


def saved_store(spark: SparkSession, sf_dir: str) -> CandidateStore:
    store, profiles = CandidateStore(spark, scratch_path(spark, "store"), buckets=16), scored(spark, sf_dir)
    for k, at in enumerate(AT):
        store.save(profiles.filter(F.pmod(F.col("run_id").cast("long"), F.lit(2)) == k), at, I.AS_OF)
    return store


@query(f"""{SUMMARY}, email AS (SELECT DISTINCT unnest(string_split(emails, '|')) AS value FROM whole), phone AS (SELECT DISTINCT unnest(string_split(phones, '|')) AS value FROM whole)
  SELECT 'candidates' AS statistic, CAST(count(DISTINCT candidate_id) AS DOUBLE) AS exact, true AS within FROM whole
  UNION ALL SELECT 'emails', CAST(count(*) AS DOUBLE), true FROM email WHERE value <> '' UNION ALL SELECT 'phones', CAST(count(*) AS DOUBLE), true FROM phone WHERE value <> ''
  UNION ALL SELECT 'confidence_p50', quantile_disc(overall_confidence, 0.5), true FROM whole UNION ALL SELECT 'confidence_p90', quantile_disc(overall_confidence, 0.9), true FROM whole""")
def store_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a store's sketches tell after two saves: the exact value, and whether the estimate keeps its bound."""
    store = saved_store(spark, sf_dir)
    rows, told = store.current(), {r.statistic: r.estimate for r in store.statistics().collect()}  # a row a statistic
    held = {"candidates": F.array("candidate_id"), "emails": F.col("emails"), "phones": F.col("phones")}
    named = F.array(*[F.struct(F.lit(s).alias("statistic"), F.lit(told.get(s)).alias("estimate"), v.alias("all")) for s, v in held.items()])
    values = rows.select(F.explode(named).alias("v")).select("v.statistic", "v.estimate", F.explode("v.all").alias("value"))
    exact = values.groupBy("statistic", "estimate").agg(F.count_distinct("value").cast("double").alias("exact"))
    out = exact.select("statistic", "exact", (F.abs(F.col("estimate") - F.col("exact")) <= F.col("exact") * DISTINCT_BOUND).alias("within"))
    confidence = F.col("overall_confidence")
    for q in QUANTILES:
        estimate = F.lit(told.get(f"confidence_p{q * 100:g}"))
        below, upto = (F.avg(test.cast("int")) for test in (confidence < estimate, confidence <= estimate))
        within = (below <= q + RANK_BOUND) & (upto >= q - RANK_BOUND)
        exactly = F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY overall_confidence)")
        out = out.unionByName(rows.agg(F.lit(f"confidence_p{q * 100:g}").alias("statistic"), exactly.alias("exact"), within.alias("within")))
    return out


@query(f"""{SUMMARY} SELECT candidate_id, full_name, headline, coalesce(emails, '') AS emails, overall_confidence, CASE WHEN CAST(run_id AS bigint) % 2 = 0 THEN '{AT[0]}' ELSE '{AT[1]}' END AS created_at FROM whole""")
def stored_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of a store after two saves."""
    rows = saved_store(spark, sf_dir).list()
    return rows.select("candidate_id", "full_name", "headline", F.array_join("emails", "|").alias("emails"), "overall_confidence", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"))
