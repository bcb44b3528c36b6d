"""Command line: one candidate from files, or a folder of candidate folders.

    python -m amalgam --csv row.csv --notes notes.txt --config shape.json --as-of 2026-06 --output out.json
    python -m amalgam --batch candidates/ --output results/ --store store/

Ends with 0, with 1 if a candidate has errors, or with 2 if there is nothing to read.
"""

from __future__ import annotations

import argparse
import json
import sys
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from amalgam.operators.store import CandidateStore
from amalgam.plans.consolidate import answer, batch_results, evaluated, summary, write_batch
from amalgam.sources.files import folder_items, text_of

ITEM = "run_id string, src_seq int, source_type string, path string, content binary"


def arguments(given: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="amalgam", description="Consolidate what sources say about a candidate.")
    for flag, told in (("csv", "spreadsheet"), ("ats-json", "HR system's export"), ("resume", "PDF or DOCX"), ("notes", "text"), ("config", "output configuration, JSON")):
        p.add_argument(f"--{flag}", type=Path, help=told)
    p.add_argument("--github", help="developer profile's URL (its landed profile is read from --landed)")
    p.add_argument("--landed", help="folder with Parquet tables users and repositories")
    p.add_argument("--batch", help="folder of candidate folders")
    p.add_argument("--output", help="file, or with --batch folder, to write")
    p.add_argument("--store", help="folder of the candidate store to save to")
    p.add_argument("--as-of", default=f"{datetime.now(UTC):%Y-%m}", help="month that ends jobs that go on")
    return p.parse_args(given)


def given_items(spark: SparkSession, a: argparse.Namespace) -> DataFrame | None:
    """The items of one candidate; null if no source is given."""
    resume = a.resume and ("resume_pdf" if a.resume.suffix.lower() == ".pdf" else "resume_docx")
    files = [(kind, path) for kind, path in (("csv", a.csv), ("ats_json", a.ats_json), (resume, a.resume), ("recruiter_txt", a.notes)) if path]
    rows = [("1", i, kind, str(path), path.read_bytes() if path.is_file() else None) for i, (kind, path) in enumerate(files)]
    if a.github:
        rows.append(("1", len(rows), "github_url", a.github, a.github.encode()))
    return spark.createDataFrame(rows, ITEM).select("run_id", "src_seq", "source_type", text_of(F.col("source_type"), F.col("content")).alias("content")) if rows else None


def stored(spark: SparkSession, a: argparse.Namespace, profiles: DataFrame, faultless: DataFrame) -> None:
    """Save the whole profiles of the candidates without errors."""
    CandidateStore(spark, a.store).save(profiles.join(faultless, "run_id", "left_semi"), f"{datetime.now(UTC):%Y-%m-%d %H:%M:%S}", a.as_of)


def landed(spark: SparkSession, a: argparse.Namespace) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{a.landed}/{t}") for t in ("users", "repositories")} if a.landed else {}


def main(given: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = arguments(given)
    spark = spark or SparkSession.builder.appName("amalgam").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    config = json.loads(a.config.read_text(encoding="utf-8")) if a.config else None
    if a.batch:
        try:
            items, folders = folder_items(spark, a.batch)
        except FileNotFoundError as e:
            print(e, file=sys.stderr)
            return 2
        results, profiles = evaluated(items, a.as_of, config, **landed(spark, a))
        told = summary(results, folders)
        if a.output:
            write_batch(batch_results(results), told, a.output)
        n = {r["status"]: r["count"] for r in told.groupBy("status").count().collect()}
        print(f"{n.get('ok', 0)}/{sum(n.values())} succeeded", file=sys.stderr)
        if a.store:
            stored(spark, a, profiles, told.filter("status = 'ok'").select(F.col("folder").alias("run_id")))
        return int(n.get("error", 0) > 0)
    items = given_items(spark, a)
    if items is None:
        print("no sources given", file=sys.stderr)
        return 2
    results, profiles = evaluated(items, a.as_of, config, **landed(spark, a))
    out = answer(results)
    text = json.dumps(out, indent=2, ensure_ascii=False)
    if a.output:
        Path(a.output).parent.mkdir(parents=True, exist_ok=True)
        Path(a.output).write_text(text, encoding="utf-8")
    else:
        print(text)
    bad = bool(out.get("error") or out.get("_errors"))
    if a.store and not bad:
        stored(spark, a, profiles, spark.createDataFrame([("1",)], "run_id string"))
    print(f"errors: {len(out.get('_errors', []))}, warnings: {len(out.get('_warnings', []))}", file=sys.stderr)
    return int(bad)


if __name__ == "__main__":
    sys.exit(main())
