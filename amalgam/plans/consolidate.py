"""From sources to projected profiles as one lazy plan, and batches of candidate folders."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from amalgam.operators.confidence import score
from amalgam.operators.merge import merge
from amalgam.operators.project import project, render
from amalgam.operators.scratch import materialised
from amalgam.sources import hr_json, profiles, prose, spreadsheet
from amalgam.sources.detect import admitted, source_type
from amalgam.sources.files import folder_items


#: Stands for a type that is not known, as a folder's name.
UNKNOWN = "unknown"


def extract(items: DataFrame, as_of: str, field_map: dict[str, str] | None = None, users: DataFrame | None = None, repositories: DataFrame | None = None) -> DataFrame:
    """Raw records of admitted sources (run_id, src_seq, source_type, content as text), each by the reader of its type.

    Developer URLs need the landed ``users`` and ``repositories``; without them they give empty records.
    """
    spark = items.sparkSession
    of = lambda *types: items.filter(F.col("source_type").isin(*types))
    if users is None:
        users = spark.createDataFrame([], "username string, profile string")
    if repositories is None:
        repositories = spark.createDataFrame([], "username string, seq int, language string")
    parts = [
        spreadsheet.from_text(of("csv")), hr_json.from_json(of("ats_json"), field_map), profiles.from_developer_urls(of("github_url"), users, repositories),
        prose.from_resumes(of("resume_pdf", "resume_docx"), as_of), prose.from_notes(of("recruiter_txt")), profiles.from_identity_profiles(of("linkedin_url")),
    ]
    return reduce(DataFrame.unionByName, parts)


def landed_by_type(items: DataFrame, path: str) -> DataFrame:
    """Items written once to ``path`` by their type (told or detected) and read again, so that each reader scans its own ones only.

    For large tables of items that are not partitioned by ``source_type``: one reading and one writing instead of a reading for each reader.
    """
    kind = F.coalesce("source_type", source_type(F.col("content")), F.lit(UNKNOWN))
    items.withColumn("source_type", kind).write.partitionBy("source_type").parquet(path)
    kinds = T.StructType([f for f in items.schema if f.name != "source_type"]).add("source_type", "string")
    return items.sparkSession.read.schema(kinds).parquet(path).withColumn("source_type", F.nullif("source_type", F.lit(UNKNOWN)))


def profiles_of(raw: DataFrame, as_of: str) -> DataFrame:
    """Scored canonical profiles of raw records."""
    return score(merge(raw, as_of))


def consolidate(items: DataFrame, as_of: str, config: dict | None = None, **landed) -> DataFrame:
    """Projected profiles of all runs with ``_warnings``, ``_errors`` (the readers' and then the projection's) and ``error``.

    ``error`` is set where a run has no usable source, or none that could be read. Each reader filters on ``source_type``: land items
    partitioned by it (:func:`landed_by_type`), so that a reader scans its own ones only.
    """
    usable, runs = admitted(items)
    return shaped(runs, profiles_of(extract(usable, as_of, **landed), as_of), config)


def shaped(runs: DataFrame, profiles: DataFrame, config: dict | None = None) -> DataFrame:
    """Profiles projected, with what :func:`admitted` says of their runs."""
    projected = project(profiles, config)
    runs = runs.select(F.col("run_id").cast("string").alias("run_id"), F.col("warnings").alias("_warnings"), F.col("errors").alias("_read"), "error")
    none = F.array().cast("array<string>")
    return runs.join(projected, "run_id", "left").withColumn("_errors", F.concat("_read", F.coalesce("_errors", none))).drop("_read")


def evaluated(items: DataFrame, as_of: str, config: dict | None = None, **landed) -> tuple[DataFrame, DataFrame]:
    """The results of :func:`consolidate` and the whole profiles, each written once, for all that reads them."""
    usable, runs = admitted(items)
    profiles, _ = materialised(profiles_of(extract(usable, as_of, **landed), as_of), "profiles")
    results, _ = materialised(shaped(runs, profiles, config), "results")
    return results, profiles


def batch(spark: SparkSession, root: str, as_of: str, config: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """(run_id, json) of all candidate folders directly in ``root``, and the summary of :func:`summary`. Files are read once, and so is the plan evaluated."""
    items, folders = folder_items(spark, root)
    results, _ = evaluated(items, as_of, config)
    return batch_results(results), summary(results, folders)


def answer(results: DataFrame) -> dict:
    """The only run's result as a dictionary; only its diagnostics where it has an error."""
    row = results.select("error", F.col("_errors").alias("errors"), F.col("_warnings").alias("warnings")).first()
    if row["error"] is None:
        return json.loads(render(results.drop("error")).first()["json"])
    return {"error": row["error"]} | {f"_{k}": row[k] for k in ("errors", "warnings") if row[k]}


def batch_results(results: DataFrame) -> DataFrame:
    """(run_id, json) of the candidates that have a profile."""
    return render(results.filter("error is null").drop("error"))


def summary(results: DataFrame, folders: DataFrame) -> DataFrame:
    """(folder, status, candidate_id, overall_confidence, errors) of each folder in order; skipped ones have no source."""
    has = lambda c, kind: F.col(c) if c in results.columns else F.lit(None).cast(kind)
    rows = results.select("run_id", has("candidate_id", "string").alias("candidate_id"), has("overall_confidence", "double").alias("overall_confidence"), F.col("_errors").alias("errors"), "error")
    joined = folders.select(F.col("run_id").cast("string").alias("run_id")).join(rows.withColumn("there", F.lit(True)), "run_id", "left")
    failed = F.col("error").isNotNull() | (F.size(F.coalesce("errors", F.array().cast("array<string>"))) > 0)
    status = F.when(F.col("there").isNull(), "skipped").when(failed, "error").otherwise("ok")
    return joined.select(F.col("run_id").alias("folder"), status.alias("status"), "candidate_id", "overall_confidence", "errors").orderBy("folder")


def write_batch(results: DataFrame, summary_rows: DataFrame, path: str) -> None:
    """One line of JSON for each candidate (run_id and profile), clustered by run_id, and the summary as JSON."""
    name = F.to_json(F.array("run_id"))
    line = F.concat(F.lit('{"run_id": '), F.substring(name, 2, F.length(name) - 2), F.lit(', "profile": '), "json", F.lit("}"))
    results.repartitionByRange("run_id").sortWithinPartitions("run_id").select(line.alias("value")).write.text(f"{path}/profiles")
    summary_rows.write.json(f"{path}/summary")
