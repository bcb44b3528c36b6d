"""Recruiter notes and resume texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from amalgam.functions import text as T
from amalgam.functions.normalize import emails_in_text
from amalgam.sources.schema import raw_records


def from_notes(rows: DataFrame) -> DataFrame:
    """One record from each note in ``content``."""
    t = F.col("content")
    return raw_records(
        rows, full_name=T.name(t), emails=emails_in_text(t), phones=F.slice(T.phone_candidates(t), 1, 5), linkedin_url=T.linkedin_url(t), github_url=T.github_url(t), skills_raw=T.keyword_skills(t),
    )


def from_resumes(rows: DataFrame, as_of: str) -> DataFrame:
    """One record from each resume's text in ``content``; jobs that go on count until ``as_of`` (YYYY-MM)."""
    read = rows.withColumn("_jobs", T.jobs(F.col("content")))
    t = F.col("content")
    return raw_records(
        read, full_name=T.name(t), emails=emails_in_text(t), phones=T.resume_phones(t), linkedin_url=T.linkedin_url(t), github_url=T.github_url(t), portfolio_url=T.portfolio_url(t),
        skills_raw=T.keyword_skills(t), experience=F.col("_jobs"), education=T.courses(t), years_experience=T.years_of(F.col("_jobs"), as_of, only_forward=False),
    )
