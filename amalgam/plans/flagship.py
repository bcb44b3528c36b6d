"""The flagship plan: raw records to scored, projected profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from amalgam.operators.project import project
from amalgam.plans import inputs as I
from amalgam.plans.consolidate import profiles_of


def consolidated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project(profiles_of(I.sources(spark, sf_dir), I.AS_OF)).drop("_errors", "_omitted")
