"""Queries over large dictionaries, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from amalgam.functions import normalize, numbering
from amalgam.operators import phrases
from amalgam.plans import inputs as I
from amalgam.plans.queries import query

#: Names of parts, and what benchmark texts say between two commas or full stops.
PHRASES = r"SELECT p_name AS phrase FROM part UNION ALL SELECT p_type FROM part UNION ALL SELECT {explode}({split}) FROM benchmark"


@query(r"""WITH given AS (SELECT p_name AS phrase FROM part UNION ALL SELECT p_type FROM part UNION ALL SELECT unnest(string_split_regex(text, '[,.]')) FROM benchmark),
    known AS (SELECT DISTINCT words, len(words) AS n FROM (SELECT regexp_extract_all(lower(phrase), '[\p{L}\p{N}]+') AS words FROM given) WHERE len(words) > 0),
    part_of AS (SELECT array_to_string(words, ' ') AS phrase, n, unnest(words) AS word, unnest(range(n)) AS i FROM known),
    said AS (SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS pos FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS words FROM documents)),
    place AS (SELECT doc_id, phrase, pos - i AS start FROM said JOIN part_of USING (word) GROUP BY doc_id, phrase, n, pos - i HAVING count(*) = n)
  SELECT doc_id, phrase, count(*) AS n, min(start) AS first FROM place GROUP BY doc_id, phrase""")
def phrase_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and clauses of the other tables that stand in documents."""
    known = I.view(spark, sf_dir, PHRASES.format(explode="explode", split="split(text, '[,.]')"))
    return phrases.phrase_hits(I.view(spark, sf_dir, "SELECT * FROM documents", deal=True), "doc_id", "text", known, "phrase")


#: A number with a calling code of one to three digits and none to thirteen more, from each order.
ABROAD = "SELECT o_orderkey, '+' || (o_orderkey * 7 % 1000) || ' ' || substr('2345678901234', 1, cast(o_orderkey % 14 AS integer)) AS raw FROM orders"

_CODES = ", ".join(f"('{code}', {fewest}, {most})" for code, (fewest, most) in numbering.calling_codes().items())
_REST = [(calling, f"regexp_replace(substr(d, {len(calling) + 1}), '^{trunk if trunk == '0' else '$'}', '')", form) for calling, trunk, form in dict.fromkeys(normalize.PLANS.values())]
_OWN = " ".join(f"WHEN starts_with(d, '{calling}') THEN CASE WHEN regexp_matches({rest}, '{form}') THEN '+{calling}' || {rest} END" for calling, rest, form in _REST)


@query(f"""WITH code(code, fewest, most) AS (VALUES {_CODES}), given AS (SELECT o_orderkey, raw, regexp_replace(raw, '\\D', '', 'g') AS d FROM ({ABROAD})),
    led AS (SELECT o_orderkey, arg_max(code, len(code)) AS code, arg_max(fewest, len(code)) AS fewest, arg_max(most, len(code)) AS most FROM given JOIN code ON code IN (substr(d, 1, 1), substr(d, 1, 2), substr(d, 1, 3)) GROUP BY o_orderkey)
  SELECT g.o_orderkey, raw, CASE {_OWN} WHEN l.code IS NOT NULL AND len(d) BETWEEN 8 AND 15 AND len(d) - len(l.code) BETWEEN fewest AND most THEN '+' || d END AS phone FROM given g LEFT JOIN led l USING (o_orderkey)""")
def phone_abroad(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers with a calling code: unassigned codes and wrong lengths are null."""
    return I.view(spark, sf_dir, ABROAD).select("o_orderkey", "raw", normalize.phone(F.col("raw")).alias("phone"))
