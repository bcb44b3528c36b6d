"""Identity resolution over variants of customers and suppliers, with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from amalgam.operators import identity
from amalgam.plans import inputs as I
from amalgam.plans.queries import query

#: Names, addresses and numbers from a key: invented syllables, so that names are many and some are alike.
_FIRST = "rtrim(substr('anna  bela  carl  dora  emil  fritz gerda hanna igor  jana  karl  lena  maria nora  otto  paul  quinn rosa  sven  tilda ', 1 + 6 * cast({k} * 7 % 20 AS int), 6))"
_LAST = "(substr('bakdorfengilholkarlammornevpolrudsam', 1 + 3 * cast({k} % 12 AS int), 3) || substr('aneiouarelinosut', 1 + 2 * cast(floor({k} / 12) % 8 AS int), 2) || substr('bergmannsoncourtfieldburghsteinhardtwald', 1 + 5 * cast(floor({k} / 96) % 8 AS int), 5))"


def _base(key: str, nation: str, table: str, shift: int) -> str:
    k = f"({key} + {shift})"
    return f"SELECT {key} AS k, {_FIRST.format(k=k)} AS first_name, {_LAST.format(k=k)} AS last_name, cast({k} * 7919 % 8999999 + 1000000 AS varchar(9)) AS number, 'City ' || {nation} AS place FROM {table}"


#: Every customer and supplier; every fourth customer once more as another source has them: in capitals, with a letter lost or changed, with another
#: address or number, or without either. Twins have the customer's id plus one.
PEOPLE = f"""
WITH c AS ({_base("c_custkey", "c_nationkey", "customer", 0)}), s AS ({_base("s_suppkey", "s_nationkey", "supplier", 500017)}),
  t AS (SELECT c.*, floor(k / 4) % 6 AS kind, first_name || '.' || last_name || k AS box FROM c WHERE k % 4 = 0)
SELECT 4 * k AS id, first_name || ' ' || last_name AS name, first_name || '.' || last_name || k || '@example.com' AS email, '+1 212 ' || number AS phone, place FROM c
UNION ALL SELECT 4 * k + 2, first_name || ' ' || last_name, last_name || k || '@firm.example', '+1 415 ' || number, place FROM s
UNION ALL SELECT 4 * k + 1,
  CASE kind WHEN 0 THEN upper(first_name || '  ' || last_name) WHEN 1 THEN first_name || ' ' || substr(last_name, 1, 2) || substr(last_name, 4, 20) WHEN 2 THEN first_name || ' ' || last_name || 's' ELSE first_name || ' ' || last_name END,
  CASE kind WHEN 2 THEN NULL WHEN 3 THEN first_name || '.' || last_name || '@mail.example.org' WHEN 4 THEN '' WHEN 5 THEN substr(box, 1, 3) || substr(box, 5, 60) || '@example.com' ELSE box || '@example.com' END,
  CASE kind WHEN 1 THEN NULL WHEN 4 THEN 'n/a' WHEN 5 THEN '1212' || substr(number, 1, 6) || '0' ELSE '(1212) ' || number END, place FROM t"""

_SHARE = lambda table, f: f"coalesce(s.{table}_{f}[{f} + 1], 1)"
_M, _U = (" * ".join(_SHARE(t, f) for f in identity.FIELDS) for t in "mu")
_START = ", ".join(f"{table}::DOUBLE[] AS {t}_{f}" for f, starts in identity.FIELDS.items() for t, table in zip("mu", starts))
_LEVEL = "(sum({w}) FILTER (WHERE {f} = {i}) IS NOT NULL)"


def _next() -> str:
    """A round's new shares: each level's part of the weight of the pairs whose field is known."""
    out = []
    for f, (starts, _) in identity.FIELDS.items():
        for t, w in (("m", "w"), ("u", "n - w")):
            total = f"(coalesce(sum({w}) FILTER (WHERE {f} IS NOT NULL), 0) + {identity.FLOOR} * {len(starts)})"
            levels = ", ".join(f"(coalesce(sum({w}) FILTER (WHERE {f} = {i}), 0) + {identity.FLOOR}) / {total}" for i in range(len(starts)))
            out.append(f"[{levels}] AS {t}_{f}")
    return ", ".join(out)


LINKED = f"""WITH RECURSIVE raw AS ({PEOPLE}),
  clean AS (SELECT id, nullif(trim(regexp_replace(lower(name), '\\s+', ' ', 'g')), '') AS name, nullif(trim(lower(email)), '') AS email, regexp_replace(coalesce(phone, ''), '[^0-9]', '', 'g') AS digits, nullif(trim(lower(place)), '') AS place FROM raw),
  person AS (SELECT id, name, email, CASE WHEN length(digits) >= 7 THEN digits END AS phone, place, string_split(name, ' ')[-1] AS last FROM clean),
  keyed AS (SELECT id, name, unnest(['e:' || email, 'p:' || right(phone, 7), 'b:' || substr(name, 1, 1) || ':' || substr(last, 1, 4) || ':' || coalesce(place, ''), 'x:' || substr(name, 1, 1) || ':' || right(last, 4) || ':' || coalesce(place, '')]) AS key FROM person),
  sized AS (SELECT *, count(*) OVER (PARTITION BY key) AS n FROM keyed WHERE key IS NOT NULL),
  finer AS (SELECT id, CASE WHEN n > {identity.BLOCK} THEN key || ':' || coalesce(name, '') ELSE key END AS key FROM sized),
  block AS (SELECT id, key FROM finer QUALIFY count(*) OVER (PARTITION BY key) BETWEEN 2 AND {identity.BLOCK}),
  pair AS (SELECT DISTINCT x.id AS a, y.id AS b FROM block x JOIN block y ON x.key = y.key AND x.id < y.id),
  level AS (SELECT a, b, CASE WHEN x.name IS NULL OR y.name IS NULL THEN NULL WHEN x.name = y.name THEN 3 WHEN jaro_winkler_similarity(x.name, y.name) >= {identity.CLOSE} THEN 2 WHEN jaro_winkler_similarity(x.name, y.name) >= {identity.NEAR} THEN 1 ELSE 0 END AS name,
      CASE WHEN x.email IS NULL OR y.email IS NULL THEN NULL WHEN x.email = y.email THEN 2 WHEN levenshtein(x.email, y.email) <= 2 THEN 1 ELSE 0 END AS email,
      CASE WHEN x.phone IS NULL OR y.phone IS NULL THEN NULL WHEN x.phone = y.phone THEN 2 WHEN right(x.phone, 7) = right(y.phone, 7) OR levenshtein(x.phone, y.phone) <= 1 THEN 1 ELSE 0 END AS phone,
      CASE WHEN x.place IS NULL OR y.place IS NULL THEN NULL WHEN x.place = y.place THEN 1 ELSE 0 END AS place
    FROM pair JOIN person x ON x.id = a JOIN person y ON y.id = b),
  pattern AS (SELECT name, email, phone, place, CAST(count(*) AS DOUBLE) AS n FROM level GROUP BY ALL),
  em AS (SELECT 0 AS round, CAST({identity.PRIOR} AS DOUBLE) AS share, {_START}
    UNION ALL SELECT round + 1, least(greatest(sum(w) / sum(n), {identity.FLOOR}), 1 - {identity.FLOOR}), {_next()}
      FROM (SELECT s.round, p.*, n * (share * {_M}) / (share * {_M} + (1 - share) * {_U}) AS w FROM em s CROSS JOIN pattern p WHERE s.round < {identity.ROUNDS}) GROUP BY round),
  s AS (SELECT * FROM em WHERE round = (SELECT max(round) FROM em)),
  link AS (SELECT a, b, (share * {_M}) / (share * {_M} + (1 - share) * {_U}) AS probability FROM level CROSS JOIN s),
  tied AS (SELECT a, b, probability FROM link WHERE probability >= {identity.THRESHOLD} UNION ALL SELECT b, a, probability FROM link WHERE probability >= {identity.THRESHOLD}),
  reach AS (SELECT id, id AS other FROM raw UNION SELECT r.id, t.b FROM reach r JOIN tied t ON t.a = r.other),
  least_id AS (SELECT id, min(other) AS person FROM reach GROUP BY id)
SELECT l.id, l.person, count(t.a) AS n_links, round(max(t.probability), 4) AS probability FROM least_id l LEFT JOIN tied t ON t.a = l.id GROUP BY ALL"""


@query(LINKED)
def linked_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of three sources that are the same person, by blocking, fitted weights and components."""
    return identity.resolve(I.view(spark, sf_dir, PEOPLE)).withColumn("probability", F.round("probability", 4))
