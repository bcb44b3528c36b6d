"""A store's statistics: sketches a bucket, made anew with it, and their estimates against exact figures."""

import random

import pytest
from pyspark.sql import functions as F

from amalgam.operators.sketches import DISTINCT_BOUND, RANK_BOUND, bucket_sketches, estimates
from amalgam.operators.store import CandidateStore
from amalgam.plans.consolidate import profiles_of
from amalgam.sources.schema import raw_records

PROFILE = "bucket int, candidate_id string, emails array<string>, phones array<string>, skills array<struct<name: string>>, overall_confidence double"


def test_estimates_keep_their_bounds(spark):
    """40,000 profiles in 32 buckets; every e-mail is held by two of them, in different buckets."""
    rows = spark.range(40_000).selectExpr(
        "cast(id % 32 AS int) AS bucket", "cast(id AS string) AS candidate_id", "array(concat('m', id div 2)) AS emails", "array(concat('+1', id % 5000)) AS phones",
        "array(named_struct('name', concat('s', id % 10))) AS skills", "round(pmod(xxhash64(id), 1000) / 1000, 3) AS overall_confidence")
    told = {r.statistic: r for r in estimates(bucket_sketches(rows), (0.1, 0.5, 0.9)).collect()}
    for name, want in (("candidates", 40_000), ("emails", 20_000), ("phones", 5_000), ("skills", 10)):
        assert told[name].n == 40_000 and told[name].estimate == pytest.approx(want, rel=DISTINCT_BOUND)
    for q in (0.1, 0.5, 0.9):
        got = told[f"confidence_p{q * 100:g}"].estimate
        below, upto = rows.agg(F.avg((F.col("overall_confidence") < got).cast("int")), F.avg((F.col("overall_confidence") <= got).cast("int"))).first()
        assert below <= q + RANK_BOUND and upto >= q - RANK_BOUND


def test_order_and_partitions_change_no_count(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(4), f"c{i}", [f"m{rng.randrange(300)}"], None, [], None) for i in range(2000)]
    first = spark.createDataFrame(rows, PROFILE)
    told = [{r.statistic: (r.n, r.estimate) for r in estimates(bucket_sketches(df)).collect()} for df in (first, first.repartition(7).unionByName(first))]
    assert told[0].keys() == told[1].keys() == {"candidates", "emails"}
    assert all(told[1][s][0] == 2 * n and told[1][s][1] == pytest.approx(e, rel=DISTINCT_BOUND) for s, (n, e) in told[0].items())


def test_nulls_and_empty_tables(spark):
    rows = [(0, None, None, [None, "+1"], None, None), (0, "a", [], ["+1"], [("Go",), None], 0.5)]
    told = {r.statistic: (r.n, r.estimate) for r in estimates(bucket_sketches(spark.createDataFrame(rows, PROFILE))).collect()}
    assert told == {"candidates": (1, 1.0), "phones": (2, 1.0), "skills": (1, 1.0), "confidence_p50": (1, 0.5), "confidence_p90": (1, 0.5)}
    assert estimates(bucket_sketches(spark.createDataFrame([], PROFILE))).collect() == []


def people(spark, ids):
    rows = spark.createDataFrame([(str(i), 0, "csv", f"P{i}", f"p{i}@x.io") for i in ids], "run_id string, src_seq int, source_type string, name string, mail string")
    return profiles_of(raw_records(rows, full_name=F.col("name"), emails=F.array("mail")), "2026-06")


def test_a_save_sketches_its_buckets_only_and_others_are_kept(spark, tmp_path):
    store = CandidateStore(spark, f"file://{tmp_path}/store", buckets=8)
    store.save(people(spark, range(40)), "2026-01-01 00:00:00", "2026-06")
    before = store._manifest()["sketches"]
    store.save(people(spark, [3]), "2026-01-02 00:00:00", "2026-06")
    after = store._manifest()["sketches"]
    assert before.keys() == after.keys() and sum(before[b] != after[b] for b in before) == 1
    want = {"candidates": (40, 40.0), "emails": (40, 40.0)}
    told = lambda: {r.statistic: (r.n, round(r.estimate)) for r in store.statistics(()).collect()}
    assert told() == want
    store.vacuum()
    assert told() == want
    assert CandidateStore(spark, f"file://{tmp_path}/none").init().statistics().collect() == []


def test_buckets_of_an_older_table_are_sketched_when_asked(spark, tmp_path):
    store = CandidateStore(spark, f"file://{tmp_path}/store", buckets=8)
    store.save(people(spark, range(20)), "2026-01-01 00:00:00", "2026-06")
    now = store._manifest()
    some = dict(list(now["sketches"].items())[:2])
    assert store._commit(now | {"number": now["number"] + 1, "sketches": some})
    assert {r.statistic: (r.n, round(r.estimate)) for r in store.statistics(()).collect()} == {"candidates": (20, 20.0), "emails": (20, 20.0)}
