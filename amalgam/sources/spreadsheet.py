"""Recruiter spreadsheets: a file's text with one candidate, or a whole table with one candidate a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from amalgam.functions import dictionaries as D
from amalgam.functions import normalize as N
from amalgam.sources.schema import raw_records

#: A record, and a field with its comma; possessive, so that long cells need no deep stack.
RECORD = r'(?s)^((?:[^"\r\n]++|"(?:[^"]++|"")*+")*+)'
FIELD = r'(?s)("(?:[^"]++|"")*+"[^,]*+|[^,]*+),'


def cells(record: Column) -> Column:
    raw = F.regexp_extract_all(F.concat(record, F.lit(",")), F.lit(FIELD), F.lit(1))
    quoted = lambda c: F.regexp_replace(F.regexp_replace(c, r'^"|"$', ""), '""', '"')
    return F.transform(raw, lambda c: F.when(c.startswith('"'), quoted(c)).otherwise(c))


def first_row(text: Column) -> Column:
    """A struct of the header's and the first record's cells."""
    clean = F.regexp_replace(text, "^(?:﻿)?[\r\n]*", "")

    def split(t: Column) -> Column:
        header = F.regexp_extract(t, RECORD, 1)
        rest = F.regexp_replace(F.substring(t, F.length(header) + 1, F.length(t)), "^[\r\n]+", "")
        row = F.regexp_extract(rest, RECORD, 1)
        return F.struct(cells(header).alias("header"), F.when(row != "", cells(row)).alias("cells"))

    return N.let(clean, split)


def from_fields(rows: DataFrame, field: dict[str, Column]) -> DataFrame:
    """Raw records from one text column for each field, null where there is none."""
    job = F.struct(*[field[k].alias(k) if k in field else F.lit(None).cast("string").alias(k) for k in ("company", "title", "start", "end", "summary")])
    one = lambda c: F.when(c.isNotNull(), F.array(c))
    return raw_records(
        rows, **{k: field[k] for k in ("full_name", "location_raw", "linkedin_url", "github_url", "headline")}, emails=one(field["emails"]), phones=one(field["phones"]),
        skills_raw=N.comma_list(field["skills_raw"]), experience=F.when(field["company"].isNotNull() | field["title"].isNotNull(), F.array(job)),
    )


def from_text(rows: DataFrame) -> DataFrame:
    """One record from each ``content``: its first data row, under its own header. Later columns of a field win."""
    table = rows.withColumn("_row", first_row(F.col("content")))
    names = N.literal_map(D.CSV_FIELDS)
    pairs = F.arrays_zip(F.col("_row.header").alias("header"), F.coalesce("_row.cells", F.array().cast("array<string>")).alias("cell"))
    table = table.withColumn("_pairs", F.transform(pairs, lambda p: F.struct(F.try_element_at(names, F.lower(N.strip(p["header"]))).alias("field"), N.strip(p["cell"]).alias("value"))))
    value = lambda f: F.try_element_at(F.filter("_pairs", lambda p: (p["field"] == f) & (p["value"] != "")), F.lit(-1))["value"]
    return from_fields(table, {f: value(f) for f in dict.fromkeys(D.CSV_FIELDS.values())})


def from_table(rows: DataFrame) -> DataFrame:
    """One record from each row of a table whose column names are headers (besides the key columns)."""
    found: dict[str, Column] = {}
    for name in rows.columns:
        field = D.CSV_FIELDS.get(name.strip().lower())
        if field:
            cell = N.filled(N.strip(F.col(f"`{name}`").cast("string")))
            found[field] = F.coalesce(cell, found[field]) if field in found else cell
    none = F.lit(None).cast("string")
    return from_fields(rows, {f: found.get(f, none) for f in dict.fromkeys(D.CSV_FIELDS.values())})
