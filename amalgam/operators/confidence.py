"""Score a profile's fields, skills and the whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from amalgam.functions import dictionaries as D
from amalgam.functions import normalize as N


def base(name: Column, unknown: float) -> Column:
    return F.coalesce(F.try_element_at(N.literal_map(D.CONFIDENCE), name), F.lit(unknown))


def source_confidence(source: Column, method: Column) -> Column:
    """The best source's confidence, moved a little by the method's."""
    best = F.array_max(F.transform(F.split(source, ","), lambda s: base(N.strip(s), D.UNKNOWN_SOURCE)))
    moved = best + (base(method, D.UNKNOWN_METHOD) - D.METHOD_LEVEL) * D.METHOD_SHARE
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), moved))


def field_confidence(provenance: Column, field: str, present: Column) -> Column:
    """By the field's first provenance entry; 0 if the field is empty, a default if nothing tells where it is from."""

    def scored(entry: Column) -> Column:
        bonus = F.when(entry["source"].contains(","), D.SEVERAL).otherwise(0.0)
        return F.when(entry.isNull(), D.UNKNOWN_SOURCE).otherwise(F.least(F.lit(1.0), source_confidence(entry["source"], entry["method"]) + bonus))

    first = F.get(F.filter(provenance, lambda p: p["field"] == field), 0)
    return F.when(~present, 0.0).otherwise(N.let(first, scored))


def field_scores() -> dict[str, Column]:
    p = F.col("provenance")
    there = {f: F.size(f) > 0 for f in ("emails", "phones", "skills", "experience", "education")}
    there |= {f: F.coalesce(F.col(f), F.lit("")) != "" for f in ("full_name", "headline")}
    there |= {f: F.col(f).isNotNull() for f in ("location", "years_experience")}
    there["links"] = F.lit(True)  # always holds a list of other links
    return {f: field_confidence(p, f, there[f]) for f in D.FIELD_WEIGHTS}


def skill_confidence(sources: Column) -> Column:
    best = F.coalesce(F.array_max(F.transform(sources, lambda s: base(s, D.UNKNOWN_SOURCE))), F.lit(D.UNKNOWN_SOURCE))
    return F.least(F.lit(1.0), best * D.KEYWORD + F.when(F.size(sources) > 1, D.SEVERAL).otherwise(0.0))


def overall(scores: dict[str, Column]) -> Column:
    total = None
    for field, weight in D.FIELD_WEIGHTS.items():
        part = scores[field] * weight
        total = part if total is None else total + part
    return F.bround(total / sum(D.FIELD_WEIGHTS.values()), 3)


@N.once_a_session
def scores() -> tuple[Column, Column]:
    """A profile's overall confidence, and its skills with theirs."""
    skills = F.transform("skills", lambda s: F.struct(s["name"].alias("name"), skill_confidence(s["sources"]).alias("confidence"), s["sources"].alias("sources")))
    return overall(field_scores()), skills


def score(profiles: DataFrame) -> DataFrame:
    whole, skills = scores()
    return profiles.withColumn("overall_confidence", whole).withColumn("skills", skills)
