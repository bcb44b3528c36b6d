"""Find out what a source is, and which sources of a run can be used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from amalgam.functions import dictionaries as D
from amalgam.functions import normalize as N

UNREADABLE = "its content could not be read"
NO_PROFILE = "LinkedIn source skipped: a URL alone holds no profile; land the profile that its owner released as JSON"


def source_type(path: Column) -> Column:
    """The type that a path or URL tells, else null. A file name that only starts with a dot has no extension."""
    s = N.strip(path)
    name = F.regexp_extract(F.regexp_replace(s, "/+$", ""), r"([^/]*)$", 1)
    extension = F.lower(F.regexp_extract(name, r"[^.].*\.([^.]+)$", 1))
    return (
        F.when(s.startswith("https://github.com") | s.startswith("http://github.com"), "github_url")
        .when(s.startswith("https://linkedin.com") | s.contains("linkedin.com/in/"), "linkedin_url")
        .otherwise(F.try_element_at(N.literal_map(D.EXTENSIONS), extension))
    )


def admitted(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Usable sources, and per run its warnings, its readers' errors and, where nothing is left, its error.

    ``items``: run_id, src_seq, source_type (null: detect it) and content. A LinkedIn source needs a profile in JSON. A source of a
    known type without content could not be read; an optional column ``extract_error`` tells why, also of one with content.
    """
    kind = F.coalesce("source_type", source_type(F.col("content")))
    head = F.substring(F.coalesce("content", F.lit("")), 1, 60)
    is_profile = F.coalesce(F.schema_of_variant(F.try_parse_json("content")).startswith("OBJECT"), F.lit(False))
    warning = F.when(kind.isNull(), F.concat(F.lit("Unknown source type: "), head)).when(~kind.isin(*D.SOURCES), F.concat(F.lit("No extractor for type: "), kind))
    warning = warning.when((kind == "linkedin_url") & F.col("content").isNotNull() & ~is_profile, NO_PROFILE)
    reason = F.coalesce(F.col("extract_error") if "extract_error" in items.columns else F.lit(None).cast("string"), F.when(F.col("content").isNull(), UNREADABLE))
    rows = items.withColumn("source_type", kind).withColumn("warning", warning)
    rows = rows.withColumn("failure", F.when(F.col("warning").isNull(), F.concat(F.lit("Extractor "), "source_type", F.lit(" failed: "), reason)))
    told = lambda c: F.transform(F.sort_array(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("src_seq", c)))), lambda w: w[c])
    error = F.when(F.count_if(F.col("warning").isNull()) == 0, "No usable sources").when(F.count_if(F.col("warning").isNull() & F.col("failure").isNull()) == 0, "All extractors failed")
    runs = rows.groupBy("run_id").agg(told("warning").alias("warnings"), told("failure").alias("errors"), error.alias("error"))
    return rows.filter("warning is null and failure is null").drop("warning", "failure", "extract_error"), runs
