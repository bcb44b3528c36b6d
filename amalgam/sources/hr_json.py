"""HR-system exports: JSON objects whose keys and shapes differ from system to system, read as VARIANT."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from amalgam.functions import dictionaries as D
from amalgam.functions import normalize as N
from amalgam.sources.schema import raw_records


def at(v: Column, key: str, kind: str) -> Column:
    quote = '"' if "'" in key else "'"
    if quote in key:
        raise ValueError("a key with both kinds of quotes can't be addressed")
    return F.try_variant_get(v, f"$[{quote}{key}{quote}]", kind)


def kind_of(v: Column) -> Column:
    return F.schema_of_variant(v)


def text(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def first_filled(v: Column, keys: tuple[str, ...]) -> Column:
    return F.coalesce(*[N.filled(at(v, k, "string")) for k in keys])


def items(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def is_list(v: Column) -> Column:
    return F.coalesce(kind_of(v).startswith("ARRAY"), F.lit(False))


def is_text(v: Column) -> Column:
    return F.coalesce(kind_of(v) == "STRING", F.lit(False))


def is_object(v: Column) -> Column:
    return F.coalesce(kind_of(v).startswith("OBJECT"), F.lit(False))


def from_json(rows: DataFrame, field_map: dict[str, str] | None = None) -> DataFrame:
    """One record from each ``content``; ``field_map`` (key -> field) is laid over the default one for this call only.

    Content that isn't a JSON object gives an empty record. A value of a wrong type in an entry is null; nothing else of
    the record is lost for it.
    """
    keys: dict[str, list[str]] = {}
    for key, field in {**D.ATS_FIELDS, **(field_map or {})}.items():
        keys.setdefault(field, []).append(key)
    table = rows.withColumn("_v", F.try_parse_json("content"))
    present = lambda k: F.when(~F.is_variant_null(at(F.col("_v"), k, "variant")), at(F.col("_v"), k, "variant"))
    for field, names in keys.items():
        table = table.withColumn(f"_{field}", F.coalesce(*[present(k) for k in reversed(names)]))
    v = {field: F.col(f"_{field}") for field in keys}
    none = F.lit(None).cast("string")
    scalar = lambda f: text(v[f]) if f in v else none
    parts = N.filled(N.strip(F.concat_ws(" ", N.filled(scalar("first_name")), N.filled(scalar("last_name")))))

    def texts(field: str) -> Column:
        listed = F.filter(F.transform(items(v[field]), text), lambda e: F.coalesce(e, F.lit("")) != "")
        return F.when(is_list(v[field]), listed).when(is_text(v[field]), F.filter(F.array(text(v[field])), lambda e: e != ""))

    named = F.array_compact(F.transform(items(v["skills_raw"]), lambda s: F.when(is_text(s), text(s)).when(is_object(s), first_filled(s, D.ATS_SKILL))))
    skills = F.when(is_list(v["skills_raw"]), named).when(is_text(v["skills_raw"]), N.comma_list(text(v["skills_raw"])))

    def entries(field: str, spec: dict[str, tuple[str, ...]]) -> Column:
        value = lambda e, k: first_filled(e, spec[k]).try_cast("int") if k == "end_year" else first_filled(e, spec[k])
        objects = F.filter(items(v[field]), is_object)
        return F.when(is_list(v[field]), F.transform(objects, lambda e: F.struct(*[value(e, k).alias(k) for k in spec])))

    return raw_records(
        table, full_name=F.coalesce(scalar("full_name"), parts), location_raw=scalar("location_raw"), linkedin_url=scalar("linkedin_url"), github_url=scalar("github_url"),
        headline=scalar("headline"), emails=texts("emails"), phones=texts("phones"), skills_raw=skills, experience=entries("experience", D.ATS_EXPERIENCE), education=entries("education", D.ATS_EDUCATION),
    )
