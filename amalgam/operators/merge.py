"""Merge all of a run's raw records into one canonical profile.

One exchange on ``run_id`` gathers a run's records (as many as it has sources); everything else is higher-order functions
on that sorted array, so no operator of the merge shuffles again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from amalgam.functions import dictionaries as D
from amalgam.functions import normalize as N
from amalgam.functions.text import years_of
from amalgam.sources.schema import RAW_FIELDS

PROVENANCE = "struct<field:string,source:string,method:string,note:string>"
SCALARS = {
    "full_name": ("full_name", "direct"), "location_raw": ("location", "direct+normalize"), "linkedin_url": ("links.linkedin", "direct"),
    "github_url": ("links.github", "direct"), "portfolio_url": ("links.portfolio", "direct"), "headline": ("headline", "direct"), "years_experience": ("years_experience", "direct"),
}


def priority(source: Column) -> Column:
    return F.coalesce(F.try_element_at(N.literal_map({s: i for i, s in enumerate(D.SOURCES)}), source), F.lit(D.UNKNOWN_PRIORITY))


def provenance(field: str, source: Column | str, method: str, note: Column | None = None) -> Column:
    source = F.lit(source) if isinstance(source, str) else source
    return F.struct(F.lit(field).alias("field"), source.alias("source"), F.lit(method).alias("method"), (F.lit(None) if note is None else note).cast("string").alias("note"))


def nothing() -> Column:
    return F.array().cast(f"array<{PROVENANCE}>")


def gathered(raw: DataFrame) -> DataFrame:
    """(run_id, recs): each run's records by priority of their source, then in the order given."""
    rec = F.struct(priority(F.col("source_type")).alias("prio"), "src_seq", "source_type", *RAW_FIELDS)
    return raw.groupBy("run_id").agg(F.sort_array(F.collect_list(rec)).alias("recs"))


def holders(recs: Column, field: str) -> Column:
    """Records that have the field; a number always counts, a text if it isn't blank."""
    return F.filter(recs, lambda r: r[field].isNotNull() if field == "years_experience" else ~N.blank(r[field]))


def winner(recs: Column, field: str) -> Column:
    return F.get(holders(recs, field), 0)[field]


def scalar_provenance(recs: Column, field: str) -> Column:
    """Losers first, then the winner; a loser is noted even where its value is the winner's."""
    target, method = SCALARS[field]

    def told(held: Column) -> Column:
        first = F.get(held, 0)["source_type"]
        note = F.concat(F.lit("conflict: overridden by "), first)
        losers = F.transform(F.slice(held, 2, F.greatest(F.size(held) - 1, F.lit(0))), lambda r: provenance(field, r["source_type"], "direct", note))
        return F.when(F.size(held) > 0, F.concat(losers, F.array(provenance(target, first, method)))).otherwise(nothing())

    return N.let(holders(recs, field), told)


def united(recs: Column, field: str) -> Column:
    """Distinct values of a list field over all records, in order, none empty."""
    return F.array_distinct(F.filter(F.flatten(F.transform(recs, lambda r: F.coalesce(r[field], F.array().cast("array<string>")))), lambda v: F.coalesce(v, F.lit("")) != ""))


def contributors(recs: Column, field: str) -> Column:
    """The sources that were first to bring one of the distinct values, from the most trusted on, comma-joined."""
    first = lambda v: F.get(F.filter(recs, lambda r: F.coalesce(F.array_contains(r[field], v), F.lit(False))), 0)["source_type"]
    return F.array_join(F.array_distinct(F.transform(united(recs, field), first)), ",")


def merged_skills(recs: Column) -> Column:
    """Skills by canonical name with the sources that name them; their confidence is set by scoring."""
    named = F.flatten(F.transform(recs, lambda r: F.transform(N.skills(F.coalesce(r["skills_raw"], F.array().cast("array<string>"))), lambda s: F.struct(s.alias("name"), r["source_type"].alias("source")))))

    def entries(pairs: Column) -> Column:
        names = F.array_distinct(F.transform(pairs, lambda p: p["name"]))
        of = lambda n: F.array_distinct(F.transform(F.filter(pairs, lambda p: p["name"] == n), lambda p: p["source"]))
        return F.transform(names, lambda n: F.struct(n.alias("name"), F.lit(0.0).alias("confidence"), of(n).alias("sources")))

    return N.let(named, entries)


def listed(recs: Column, field: str) -> Column:
    return F.flatten(F.filter(F.transform(recs, lambda r: r[field]), lambda x: x.isNotNull()))


def best_of_each(entries: Column, key: Callable[[Column], Column], better: Callable[[Column], Column] | None = None) -> Column:
    """One entry for each key, where the key first occurs: the first ``better`` one, else the first."""

    def chosen(all_: Column) -> Column:
        keys = F.array_distinct(F.transform(all_, key))

        def pick(k: Column) -> Column:
            own = F.filter(all_, lambda e: key(e).eqNullSafe(k))
            return F.get(own, 0) if better is None else F.coalesce(F.get(F.filter(own, better), 0), F.get(own, 0))

        return F.transform(keys, pick)

    return N.let(entries, chosen)


def merged_jobs(recs: Column) -> Column:
    """Jobs by company and title, ignoring case; an entry with a start replaces one without."""
    day = lambda x: F.when(F.coalesce(x, F.lit("")) != "", N.date(x))
    dated = F.transform(listed(recs, "experience"), lambda e: F.struct(e["company"].alias("company"), e["title"].alias("title"), day(e["start"]).alias("start"), day(e["end"]).alias("end"), e["summary"].alias("summary")))
    part = lambda x: N.strip(F.lower(F.coalesce(x, F.lit(""))))
    return best_of_each(dated, lambda e: F.struct(part(e["company"]).alias("c"), part(e["title"]).alias("t")), lambda e: e["start"].isNotNull())


def merged_courses(recs: Column) -> Column:
    return best_of_each(listed(recs, "education"), lambda e: F.struct(e["institution"].alias("i"), e["degree"].alias("d")))


def candidate_id(emails: Column, full_name: Column) -> Column:
    return F.substring(F.md5(F.concat(F.coalesce(F.get(emails, 0), F.lit("")), F.coalesce(full_name, F.lit("")))), 1, 16)


@N.once_a_session
def values() -> list[Column]:
    """What the records in ``recs`` say of each field."""
    r = F.col("recs")
    return [
        *[winner(r, f).alias(f) for f in ("full_name", "headline")], winner(r, "years_experience").alias("told_years"),
        N.location(winner(r, "location_raw")).alias("location"),
        F.struct(winner(r, "linkedin_url").alias("linkedin"), winner(r, "github_url").alias("github"), winner(r, "portfolio_url").alias("portfolio"), united(r, "other_urls").alias("other")).alias("links"),
        N.emails(united(r, "emails")).alias("emails"), N.phones(united(r, "phones")).alias("phones"),
        merged_skills(r).alias("skills"), merged_jobs(r).alias("experience"), merged_courses(r).alias("education"),
    ]


@N.once_a_session
def worked(as_of: str) -> Column:
    """Years of the merged jobs where no source tells them."""
    return F.when(F.col("told_years").isNull() & (F.size("experience") > 0), years_of(F.col("experience"), as_of, only_forward=True))


@N.once_a_session
def story() -> Column:
    """Where each field is from."""
    r = F.col("recs")
    some = lambda column, entry: F.when(F.size(column) > 0, F.array(entry)).otherwise(nothing())
    return F.concat(
        *[scalar_provenance(r, f) for f in SCALARS],
        some("emails", provenance("emails", contributors(r, "emails"), "direct+normalize")),
        some("phones", provenance("phones", contributors(r, "phones"), "direct+normalize(E164)")),
        some("skills", provenance("skills", "multiple", "keyword_match+canonicalize")),
        some("experience", provenance("experience", "multiple", "union+date_normalize")),
        F.when(F.col("worked").isNotNull(), F.array(provenance("years_experience", "multiple", "computed_from_experience"))).otherwise(nothing()),
        some("education", provenance("education", "multiple", "union")),
    )


def profiles(gathered_runs: DataFrame, as_of: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """Canonical profiles, not scored yet, from :func:`gathered`, with further columns to ``carry``.

    ``as_of`` (YYYY-MM) ends jobs that go on.
    """
    step = gathered_runs.select("run_id", "recs", *carry, *values()).withColumn("worked", worked(as_of))
    return step.select(
        "run_id", candidate_id(F.col("emails"), F.col("full_name")).alias("candidate_id"), "full_name", "emails", "phones", "location", "links", "headline",
        F.coalesce("told_years", "worked").alias("years_experience"), "skills", "experience", "education", story().alias("provenance"), *carry,
    )


def merge(raw: DataFrame, as_of: str) -> DataFrame:
    return profiles(gathered(raw), as_of)
