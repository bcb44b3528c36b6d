"""The shape of raw records, one for each source of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from amalgam.functions.text import COURSE, JOB

RAW = {
    "full_name": "string", "emails": "array<string>", "phones": "array<string>", "location_raw": "string", "linkedin_url": "string", "github_url": "string",
    "portfolio_url": "string", "other_urls": "array<string>", "headline": "string", "years_experience": "double", "skills_raw": "array<string>",
    "experience": f"array<{JOB}>", "education": f"array<{COURSE}>",
}
RAW_FIELDS = tuple(RAW)
#: What every source table has besides its content.
KEYS = ("run_id", "src_seq", "source_type")


def raw_records(rows: DataFrame, **fields: Column) -> DataFrame:
    """Raw records from a table with KEYS; lists that aren't given are empty, other fields null."""
    out = []
    for name, kind in RAW.items():
        value = fields.get(name, F.lit(None))
        value = F.coalesce(value, F.array()) if kind.startswith("array") and name in fields else F.array() if kind.startswith("array") else value
        out.append(value.cast(kind).alias(name))
    return rows.select(F.col("run_id").cast("string").alias("run_id"), F.col("src_seq").cast("int").alias("src_seq"), "source_type", *out)
