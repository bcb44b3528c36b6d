"""Reshape and check profiles by a runtime configuration, compiled once into a select list."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from amalgam.functions import normalize as N

#: Output type -> check that a Spark type can hold it. Any value may be null.
TYPES = {
    "string": lambda t: isinstance(t, T.StringType),
    "string[]": lambda t: isinstance(t, T.ArrayType) and isinstance(t.elementType, T.StringType),
    "number": lambda t: isinstance(t, T.NumericType),
    "boolean": lambda t: isinstance(t, T.BooleanType),
    "object": lambda t: isinstance(t, (T.StructType, T.MapType)),
}
DIAGNOSTICS = ("_warnings", "_errors", "_omitted")


def resolved(schema: T.StructType, path: str) -> tuple[Column, T.DataType | None]:
    """The column of ``list[].field``, ``list[0]`` or ``struct.field``, and its type; null for what isn't there."""
    nothing = F.lit(None).cast("string"), None
    fields = {f.name: f.dataType for f in schema}
    if m := re.fullmatch(r"(\w+)\[\]\.(\w+)", path):
        t = fields.get(m[1])
        if isinstance(t, T.ArrayType) and isinstance(t.elementType, T.StructType) and m[2] in t.elementType.names:
            kind = T.ArrayType(t.elementType[m[2]].dataType)
            return F.array_compact(F.transform(F.coalesce(F.col(m[1]), F.array().cast(t)), lambda x: x[m[2]])), kind
        return (F.array().cast("array<string>"), T.ArrayType(T.StringType())) if isinstance(t, T.ArrayType) or m[1] not in fields else nothing
    if m := re.fullmatch(r"(\w+)\[(\d+)\]", path):
        t = fields.get(m[1])
        return (F.get(F.col(m[1]), int(m[2])), t.elementType) if isinstance(t, T.ArrayType) else nothing
    kind: T.DataType | None = schema
    for part in path.split("."):
        kind = kind[part].dataType if isinstance(kind, T.StructType) and part in kind.names else None
        if kind is None:
            return nothing
    return F.col(path), kind


def normalized(value: Column, kind: T.DataType | None, how: str | None) -> tuple[Column, T.DataType | None]:
    """Phone numbers, skills or lower case, for a value or each of a list. Unknown names change nothing."""
    each = {"e164": N.phone, "canonical": N.skill, "lowercase": F.lower}.get((how or "").lower())
    if each is None or kind is None:
        return value, kind
    if isinstance(kind, T.ArrayType):
        texts = F.transform(value, lambda v: (v if isinstance(kind.elementType, T.StringType) else F.to_json(v) if isinstance(kind.elementType, T.StructType) else v.cast("string")))
        if each is not F.lower:
            texts = F.filter(texts, lambda v: F.coalesce(v, F.lit("")) != "")
        return F.transform(texts, each), T.ArrayType(T.StringType())
    text = value if isinstance(kind, T.StringType) else F.to_json(value) if isinstance(kind, (T.StructType, T.MapType)) else value.cast("string")
    return each(text), T.StringType()


def empty(value: Column, kind: T.DataType | None) -> Column:
    if isinstance(kind, T.ArrayType):
        return value.isNull() | (F.size(value) == 0)
    return value.isNull() | (value == "") if isinstance(kind, T.StringType) else value.isNull()


def type_error(key: str, want: str, value: Column, kind: T.DataType | None) -> Column:
    """The message of a value that hasn't the wanted type, else null."""
    fits = TYPES.get(want, TYPES["string"])
    shown = want if want in TYPES else "string"
    if kind is not None and not fits(kind):
        return F.when(value.isNotNull(), f"Validation error at '$.{key}': value is not of type {shown}")
    if shown == "string[]" and kind is not None:
        at = F.array_position(F.transform(value, lambda v: v.isNull()), True) - 1
        return F.when(F.exists(value, lambda v: v.isNull()), F.concat(F.lit(f"Validation error at '$.{key}["), at, F.lit("]': None is not of type 'string'")))
    return F.lit(None).cast("string")


def project(profiles: DataFrame, config: dict | None = None) -> DataFrame:
    """Profiles in the configured shape with ``_errors``, and ``_omitted``: keys to leave out when the row is rendered."""
    config = config or {}
    fields = [f for f in config.get("fields") or [] if f.get("path")]
    confident = config.get("include_confidence", True)
    missing = config.get("on_missing", "null")
    texts = "array<string>"
    if not fields:
        out = profiles
        if not confident:
            slim = F.transform("skills", lambda s: s.dropFields("confidence", "sources"))
            out = profiles.drop("overall_confidence", "provenance").withColumn("skills", slim)
        return out.withColumn("_errors", F.array().cast(texts)).withColumn("_omitted", F.array().cast(texts))
    keys, gaps, wrong, omitted = {}, [], [], []
    for f in fields:
        key, source = f["path"], f.get("from", f["path"])
        value, kind = normalized(*resolved(profiles.schema, source), f.get("normalize"))
        gone = empty(value, kind)
        keys[key] = F.when(~gone, value)
        if missing == "error":
            gaps.append(F.when(gone, f"Field '{key}' (from '{source}') is required but resolved to null/empty"))
        left_out = gone if missing == "omit" else F.lit(False)
        if missing == "omit":
            omitted.append(F.when(gone, key))
        lacking = F.when(left_out, f"Validation error at '$': '{key}' is a required property") if f.get("required") else F.lit(None).cast("string")
        wrong.append((bool(f.get("required")), lacking, type_error(key, f.get("type", "string"), F.when(~gone, value), kind)))
    # one validation error is told: wrong types in the order of the fields, then keys that are lacking
    first = F.coalesce(*[w[2] for w in wrong], *[w[1] for w in wrong])
    errors = F.array_compact(F.array(*gaps, first))
    more = [F.col("overall_confidence").alias("_confidence"), F.col("provenance").alias("_provenance")] if confident else []
    own = [F.col("run_id")] if "run_id" in profiles.columns and "run_id" not in keys else []
    gone_keys = F.array_compact(F.array(*omitted)) if omitted else F.array().cast(texts)
    return profiles.select(*own, *[v.alias(k) for k, v in keys.items()], *more, errors.alias("_errors"), gone_keys.alias("_omitted"))


#: What a profile in the full shape must have; other fields may be null.
REQUIRED = {
    "candidate_id": "string", "emails": "array", "phones": "array", "links": "object", "skills": "array", "experience": "array", "education": "array", "provenance": "array", "overall_confidence": "number",
}


def validate(profiles: DataFrame) -> DataFrame:
    """Add ``_valid`` and ``_error`` for profiles in the full shape: what the columns' types leave open is what may not be null.

    The first error in the order of the fields is told, that of a whole field before those of a list's entries.
    """
    problems = [F.when(F.col(c).isNull(), f"Validation error at '$.{c}': None is not of type '{kind}'") for c, kind in REQUIRED.items()]
    for c in ("emails", "phones"):
        at = F.array_position(F.transform(c, lambda v: v.isNull()), True) - 1
        problems.append(F.when(F.exists(c, lambda v: v.isNull()), F.concat(F.lit(f"Validation error at '$.{c}["), at, F.lit("]': None is not of type 'string'"))))
    error = F.coalesce(*problems)
    return profiles.withColumn("_valid", error.isNull()).withColumn("_error", error)


def render(projected: DataFrame) -> DataFrame:
    """(run_id, json): nulls stay, omitted keys, links that aren't set and empty diagnostics go."""
    columns = [c for c in projected.columns if c not in ("run_id", *DIAGNOSTICS)]
    keep = {"ignoreNullFields": "false"}

    def json_of(c: str) -> Column:
        kind = projected.schema[c].dataType
        if c == "links" and isinstance(kind, T.StructType):
            named = {k: F.col(f"links.{k}") for k in ("linkedin", "github", "portfolio") if k in kind.names}
            set_ = F.concat_ws(", ", *[F.when(v.isNotNull(), F.concat(F.lit(f'"{k}":'), F.regexp_replace(F.to_json(F.array(v)), r"^\[|\]$", ""))) for k, v in named.items()])
            other = F.concat(F.lit('"other":'), F.to_json(F.coalesce(F.col("links.other"), F.array().cast("array<string>"))))
            return F.concat(F.lit("{"), F.concat_ws(", ", N.filled(set_), other), F.lit("}"))
        wrapped = F.to_json(F.struct(F.col(f"`{c}`").alias("v")), keep)
        return F.substring(wrapped, 6, F.length(wrapped) - 6)

    pairs = [F.when(~F.array_contains("_omitted", c), F.concat(F.to_json(F.array(F.lit(c))).substr(F.lit(2), F.length(F.to_json(F.array(F.lit(c)))) - 2), F.lit(": "), json_of(c))) for c in columns]
    for c in ("_warnings", "_errors"):
        if c in projected.columns:
            pairs.append(F.when(F.size(c) > 0, F.concat(F.lit(f'"{c}": '), F.to_json(c))))
    body = F.concat(F.lit("{"), F.concat_ws(", ", *pairs), F.lit("}"))
    return projected.select(*(["run_id"] if "run_id" in projected.columns else []), body.alias("json"))
