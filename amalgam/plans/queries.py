"""The driver's queries, each with its SQL where SQL can express it. The SQL is written on its own, from the rules."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from amalgam.functions import dictionaries as D
from amalgam.functions import normalize as N
from amalgam.functions import text as T
from amalgam.operators import confidence as C
from amalgam.operators import merge as M
from amalgam.operators.fold import fold, fold_pairs
from amalgam.operators.project import project, validate
from amalgam.operators.store import get_candidate as stored_candidate
from amalgam.operators.store import list_candidates as stored_candidates
from amalgam.plans import inputs as I
from amalgam.plans.consolidate import consolidate, profiles_of, summary
from amalgam.sources import hr_json, profiles, prose, spreadsheet
from amalgam.sources.detect import admitted, source_type

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def values(pairs: dict[str, str], names: str) -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    return "(VALUES " + ", ".join(f"({i}, {quoted(k)}, {quoted(v)})" for i, (k, v) in enumerate(pairs.items())) + f") AS {names}"


# ---- SQL pieces ----

EMAIL_OK = r"[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+\.[a-zA-Z]{2,}"
NANP = "[2-9][0-8][0-9][2-9][0-9]{6}"
WORDCHAR = r"[\p{L}\p{N}_]"


def email_sql(c: str) -> str:
    return f"CASE WHEN regexp_full_match(lower(trim({c})), '{EMAIL_OK}') THEN lower(trim({c})) END"


def phone_sql(c: str) -> str:
    d = f"regexp_replace({c}, '[^0-9]', '', 'g')"
    return f"""CASE WHEN {c} LIKE '+1%' THEN CASE WHEN regexp_full_match({d}, '1{NANP}') THEN '+' || {d} END
      WHEN {c} LIKE '+44%' THEN CASE WHEN regexp_full_match({d}, '44([1-35789][0-9]{{9}}|[18][0-9]{{8}})') THEN '+' || {d} END
      WHEN {c} LIKE '+%' THEN CASE WHEN regexp_full_match({d}, '[2-9][0-9]{{7,14}}') THEN '+' || {d} END
      WHEN regexp_full_match({d}, '{NANP}') THEN '+1' || {d} WHEN regexp_full_match({d}, '1{NANP}') THEN '+' || {d} END"""


def case_sql(c: str, table: dict, unknown) -> str:
    return f"CASE {c} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in table.items()) + f" ELSE {unknown} END"


PRIORITY = case_sql("source_type", {s: i for i, s in enumerate(D.SOURCES)}, D.UNKNOWN_PRIORITY)
SRC = f"src AS (SELECT *, ({PRIORITY}) * 1000 + src_seq AS ord FROM ({I.SOURCES}))"
SKILL_TABLE = values(D.SKILLS, "dict(ord, alias, name)")


def title_sql(c: str) -> str:
    return f"array_to_string(list_transform(regexp_extract_all({c}, '[A-Za-z]+|[^A-Za-z]+'), lambda x: upper(x[1]) || lower(x[2:])), '')"


def location_sql(raws: str) -> str:
    """CTEs ending in loc(raw, city, region, country) for a query that selects raw."""
    names: dict[str, str] = {}
    for k, v in D.COUNTRIES.items():
        names.setdefault(k.lower(), v)
    names |= {c.lower(): c for c in D.COUNTRIES.values() if len(c) == 2}
    return f"""raws AS (SELECT DISTINCT raw FROM ({raws}) WHERE raw <> ''),
    pieces AS (SELECT raw, list_transform(string_split(trim(raw), ','), lambda x: trim(x)) AS p FROM raws),
    coded AS (SELECT raw, arg_max(c.code, k.pos) AS code FROM (SELECT raw, unnest(p) AS part, generate_subscripts(p, 1) AS pos FROM pieces) k
      JOIN {values(names, "c(i, name, code)")} ON c.name = lower(k.part) GROUP BY raw),
    loc AS (SELECT q.raw, CASE WHEN len(p) >= 2 THEN p[1] WHEN code IS NULL THEN trim(q.raw) END AS city, CASE WHEN len(p) >= 3 THEN p[2] END AS region,
      CASE WHEN len(p) >= 2 THEN coalesce(code, p[len(p)]) ELSE code END AS country FROM pieces q LEFT JOIN coded d ON q.raw = d.raw)"""


def winner_sql(field: str) -> str:
    return f"arg_min({field}, ord) FILTER (WHERE trim(coalesce({field}, '')) <> '')"


#: Distinct raw values with their first source, normalised; then the profile's lists and the comma-joined sources.
def union_sql(field: str, normalised: str, cte: str) -> str:
    return f"""{cte}_raw AS (SELECT run_id, {field} AS raw, min(ord) AS ord, arg_min(source_type, ord) AS st FROM src WHERE coalesce({field}, '') <> '' GROUP BY ALL),
    {cte}_norm AS (SELECT run_id, norm, min(ord) AS ord FROM (SELECT run_id, ord, {normalised} AS norm FROM {cte}_raw) WHERE norm IS NOT NULL GROUP BY ALL),
    {cte}_from AS (SELECT run_id, string_agg(st, ',' ORDER BY ord) AS sources FROM (SELECT run_id, st, min(ord) AS ord FROM {cte}_raw GROUP BY ALL) GROUP BY run_id),
    {cte} AS (SELECT n.run_id, n.vals, f.sources FROM (SELECT run_id, string_agg(norm, '|' ORDER BY ord) AS vals FROM {cte}_norm GROUP BY run_id) n JOIN {cte}_from f ON n.run_id = f.run_id)"""


EMAILS, PHONES = union_sql("email", email_sql("raw"), "emails"), union_sql("phone", phone_sql("raw"), "phones")
SKILLS = f"""named AS (SELECT run_id, ord, source_type, trim(s) AS raw, pos FROM (SELECT run_id, ord, source_type, unnest(string_split(skills, ',')) AS s, generate_subscripts(string_split(skills, ','), 1) AS pos FROM src)),
    canon AS (SELECT n.run_id, n.ord, n.pos, n.source_type, coalesce(d.name, {title_sql("n.raw")}) AS name FROM named n LEFT JOIN {SKILL_TABLE} ON d.alias = lower(n.raw))""".replace("AS dict(ord, alias, name)", "AS d(i, alias, name)")
SKILLS += """, skill_from AS (SELECT run_id, name, source_type, min(ord) AS ord, min(ord * 100 + pos) AS nth FROM canon GROUP BY ALL),
    skills AS (SELECT run_id, name, string_agg(source_type, ',' ORDER BY ord) AS sources, min(nth) AS nth FROM skill_from GROUP BY ALL)"""


def base_sql(c: str, unknown: float) -> str:
    return case_sql(c, D.CONFIDENCE, unknown)


def score_sql(source: str, method: str) -> str:
    best = f"list_max(list_transform(string_split({source}, ','), lambda s: {base_sql('s', D.UNKNOWN_SOURCE)}))"
    return f"least(1.0, least(1.0, greatest(0.0, {best} + ({base_sql(repr(method), D.UNKNOWN_METHOD)} - {D.METHOD_LEVEL}) * {D.METHOD_SHARE})) + CASE WHEN contains({source}, ',') THEN {D.SEVERAL} ELSE 0.0 END)"


def first_told_sql(field: str) -> str:
    """The source of a scalar's first provenance entry: the first loser's, else the winner's."""
    held = f"list(source_type ORDER BY ord) FILTER (WHERE trim(coalesce({field}, '')) <> '')"
    return f"coalesce(({held})[2], ({held})[1])"


FIELDS = f"""WITH {SRC}, {EMAILS}, {PHONES}, {SKILLS},
    firsts AS (SELECT run_id, {first_told_sql("full_name")} AS name_from, {first_told_sql("headline")} AS headline_from,
      arg_min(source_type, ord) FILTER (WHERE trim(coalesce(location_raw, '')) <> '') AS place_from FROM src GROUP BY run_id),
    scores AS (SELECT cast(f.run_id AS varchar) AS run_id,
      coalesce({score_sql("name_from", "direct")}, 0.0) AS full_name,
      coalesce({score_sql("e.sources", "direct+normalize")}, 0.0) AS emails, coalesce({score_sql("p.sources", "direct+normalize(E164)")}, 0.0) AS phones,
      coalesce({score_sql("place_from", "direct+normalize")}, 0.0) AS location, {score_sql("'multiple'", "keyword_match+canonicalize")} AS skills,
      0.0 AS experience, 0.0 AS education, coalesce({score_sql("headline_from", "direct")}, 0.0) AS headline, 0.0 AS years_experience, {D.UNKNOWN_SOURCE} AS links
      FROM firsts f LEFT JOIN emails e ON e.run_id = f.run_id LEFT JOIN phones p ON p.run_id = f.run_id)"""
OVERALL = "round_even(cast(" + " + ".join(f"{f} * {w}" for f, w in D.FIELD_WEIGHTS.items()) + f" AS double) / {sum(D.FIELD_WEIGHTS.values())}, 3)"
SUMMARY = f"""{FIELDS}, totals AS (SELECT run_id, {OVERALL} AS overall_confidence FROM scores), ids AS (SELECT cast(s.run_id AS varchar) AS run_id, {winner_sql("full_name")} AS full_name, {winner_sql("headline")} AS headline, {winner_sql("location_raw")} AS place FROM src s GROUP BY s.run_id),
    whole AS (SELECT i.run_id, i.full_name, i.headline, i.place, e.vals AS emails, p.vals AS phones, c.overall_confidence, string_split(e.vals, '|')[1] AS email,
      substr(md5(coalesce(string_split(e.vals, '|')[1], '') || coalesce(i.full_name, '')), 1, 16) AS candidate_id
      FROM ids i JOIN totals c ON c.run_id = i.run_id LEFT JOIN emails e ON cast(e.run_id AS varchar) = i.run_id LEFT JOIN phones p ON cast(p.run_id AS varchar) = i.run_id)"""


# ---- sources ----


@query(f"""WITH named AS (SELECT id, trim(path) AS s, regexp_extract(regexp_replace(trim(path), '/+$', ''), '([^/]*)$', 1) AS name FROM ({I.PATHS})),
    typed AS (SELECT *, lower(regexp_extract(name, '[^.].*\\.([^.]+)$', 1)) AS ext FROM named)
  SELECT id, CASE WHEN s LIKE 'https://github.com%' OR s LIKE 'http://github.com%' THEN 'github_url' WHEN s LIKE 'https://linkedin.com%' OR contains(s, 'linkedin.com/in/') THEN 'linkedin_url'
    ELSE CASE ext WHEN 'csv' THEN 'csv' WHEN 'json' THEN 'ats_json' WHEN 'pdf' THEN 'resume_pdf' WHEN 'docx' THEN 'resume_docx' WHEN 'doc' THEN 'resume_docx' WHEN 'txt' THEN 'recruiter_txt' END END AS source_type FROM typed""")
def detect_source_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.view(spark, sf_dir, I.PATHS, deal=True).select("id", source_type(F.col("path")).alias("source_type"))


ITEMS = "SELECT id AS run_id, 0 AS src_seq, CASE WHEN id % 4 = 0 THEN 'csv' END AS source_type, path AS content FROM ({paths})"


@query(f"""WITH named AS (SELECT id, trim(path) AS s, path, regexp_extract(regexp_replace(trim(path), '/+$', ''), '([^/]*)$', 1) AS name FROM ({I.PATHS})),
    typed AS (SELECT *, lower(regexp_extract(name, '[^.].*\\.([^.]+)$', 1)) AS ext FROM named),
    kinds AS (SELECT id, path, CASE WHEN id % 4 = 0 THEN 'csv' WHEN s LIKE 'https://github.com%' OR s LIKE 'http://github.com%' THEN 'github_url' WHEN s LIKE 'https://linkedin.com%' OR contains(s, 'linkedin.com/in/') THEN 'linkedin_url'
      WHEN ext IN ('csv', 'json', 'pdf', 'docx', 'doc', 'txt') THEN 'file' END AS kind FROM typed)
  SELECT cast(id AS varchar) AS run_id, CASE WHEN kind IS NULL THEN 'Unknown source type: ' || substr(path, 1, 60) WHEN kind = 'linkedin_url' THEN 'LinkedIn' ELSE '' END AS warnings,
    CASE WHEN kind IS NULL OR kind = 'linkedin_url' THEN 'No usable sources' END AS error FROM kinds""")
def source_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, runs = admitted(I.view(spark, sf_dir, ITEMS.format(paths=I.PATHS), deal=True))
    told = F.array_join("warnings", ";")
    return runs.select(F.col("run_id").cast("string").alias("run_id"), F.when(told.startswith("LinkedIn"), "LinkedIn").otherwise(told).alias("warnings"), "error")


CSV_TEXTS = f"""SELECT run_id, 0 AS src_seq, 'csv' AS source_type, 'Name,EMAIL,phone_number, Title ,location,notes,skills,name' || chr(10) || '"' || full_name || ' ""X"", Jr","' || email || '",' || phone
  || ',"Lead, Ops","Paris, France",zz," Python , js,,"' || CASE WHEN run_id % 3 = 0 THEN ',' WHEN run_id % 3 = 1 THEN ',Other' || run_id ELSE '' END || chr(10) || 'second,row' AS content FROM ({I.CONTACTS})"""


@query(f"""SELECT cast(run_id AS varchar) AS run_id, CASE WHEN run_id % 3 = 1 THEN 'Other' || run_id ELSE full_name || ' "X", Jr' END AS full_name, nullif(trim(email), '') AS email, phone,
    'Paris, France' AS location_raw, 'Lead, Ops' AS title, 'Python|js' AS skills FROM ({I.CONTACTS})""")
def csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = spreadsheet.from_text(I.view(spark, sf_dir, CSV_TEXTS, deal=True))
    return raw.select("run_id", "full_name", F.get("emails", 0).alias("email"), F.get("phones", 0).alias("phone"), "location_raw", F.get("experience", 0)["title"].alias("title"), F.array_join("skills_raw", "|").alias("skills"))


@query("SELECT cast(c_custkey AS varchar) AS run_id, c_name AS full_name, nullif(trim(c_mktsegment), '') AS headline FROM customer")
def csv_table_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bulk mode: a table with a candidate in each row."""
    rows = I.view(spark, sf_dir, "SELECT c_custkey AS run_id, 0 AS src_seq, 'csv' AS source_type, c_name AS `Full_Name`, c_mktsegment AS headline FROM customer", deal=True)
    return spreadsheet.from_table(rows).select("run_id", "full_name", "headline")


ATS_TEXTS = """SELECT c_custkey AS run_id, 0 AS src_seq, 'ats_json' AS source_type, CASE WHEN c_custkey % 11 = 10 THEN '{broken' ELSE '{"firstName":"F' || c_custkey || '","lastName":"L"'
  || CASE WHEN c_custkey % 2 = 0 THEN ',"name":"N","candidateName":"' || c_name || '"' ELSE '' END
  || CASE c_custkey % 3 WHEN 0 THEN ',"email":["a' || c_custkey || '@x.io","","b@x.io"]' WHEN 1 THEN ',"emailAddress":"c' || c_custkey || '@x.io"' ELSE '' END
  || CASE c_custkey % 4 WHEN 0 THEN ',"skills":"Go, ,Rust"' WHEN 1 THEN ',"skillSet":["SQL",{"name":"","skill":"Bash"},7]' WHEN 2 THEN ',"skills":[{"title":"Git"}]' ELSE '' END
  || ',"workHistory":[{"organization":"' || c_mktsegment || '","position":"P","startDate":"2019-0' || (1 + c_custkey % 9) || '"},"x"],"education":[{"school":"S","graduationYear":"' || (2000 + c_custkey % 20) || '"}]}' END AS content FROM customer"""


@query("""SELECT cast(c_custkey AS varchar) AS run_id, CASE WHEN c_custkey % 11 = 10 THEN NULL WHEN c_custkey % 2 = 0 THEN c_name ELSE 'F' || c_custkey || ' L' END AS full_name,
    CASE WHEN c_custkey % 11 = 10 THEN '' WHEN c_custkey % 3 = 0 THEN 'a' || c_custkey || '@x.io|b@x.io' WHEN c_custkey % 3 = 1 THEN 'c' || c_custkey || '@x.io' ELSE '' END AS emails,
    CASE WHEN c_custkey % 11 = 10 THEN '' ELSE CASE c_custkey % 4 WHEN 0 THEN 'Go|Rust' WHEN 1 THEN 'SQL|Bash' WHEN 2 THEN 'Git' ELSE '' END END AS skills,
    CASE WHEN c_custkey % 11 <> 10 THEN c_mktsegment || '/P/2019-0' || (1 + c_custkey % 9) END AS job, CASE WHEN c_custkey % 11 <> 10 THEN cast(2000 + c_custkey % 20 AS integer) END AS end_year FROM customer""")
def ats_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = hr_json.from_json(I.view(spark, sf_dir, ATS_TEXTS, deal=True))
    job = F.get("experience", 0)
    return raw.select("run_id", "full_name", F.array_join("emails", "|").alias("emails"), F.array_join("skills_raw", "|").alias("skills"), F.concat_ws("/", job["company"], job["title"], job["start"]).alias("j"), F.get("education", 0)["end_year"].alias("end_year")).select(
        "run_id", "full_name", "emails", "skills", N.filled(F.col("j")).alias("job"), "end_year"
    )


@query("""SELECT cast(c_custkey AS varchar) AS run_id, CASE WHEN c_custkey % 3 = 0 THEN 'Display ' || c_custkey ELSE 'Mapped ' || c_custkey END AS full_name FROM customer""")
def ats_field_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A caller's own key, laid over the default ones."""
    rows = I.view(spark, sf_dir, """SELECT c_custkey AS run_id, 0 AS src_seq, 'ats_json' AS source_type, '{"name":"Mapped ' || c_custkey || '"' || CASE WHEN c_custkey % 3 = 0 THEN ',"display name":"Display ' || c_custkey || '"' ELSE '' END || '}' AS content FROM customer""", deal=True)
    return hr_json.from_json(rows, {"display name": "full_name"}).select("run_id", "full_name")


@query("""WITH n AS (SELECT l_suppkey, 'Lang' || l_partkey % 13 AS kind, count(*) AS n, min(l_orderkey * 10 + l_linenumber) AS first FROM lineitem WHERE l_partkey % 13 <> 5 GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, first) AS k FROM n), top AS (SELECT l_suppkey, string_agg(kind, ',' ORDER BY k) AS skills FROM r WHERE k <= 10 GROUP BY l_suppkey),
    s AS (SELECT *, s_suppkey % 5 <> 4 AND s_suppkey % 7 <> 6 AS there FROM supplier)
  SELECT cast(s_suppkey AS varchar) AS run_id, CASE WHEN there THEN s_name END AS full_name, CASE WHEN NOT there OR s_suppkey % 3 = 2 THEN NULL WHEN s_suppkey % 3 = 0 THEN 'https://me' || s_suppkey || '.example' ELSE 'http://me.example' END AS portfolio_url,
    CASE WHEN there THEN 'https://github.com/dev' || s_suppkey END AS github_url, CASE WHEN there THEN coalesce(skills, '') ELSE '' END AS skills FROM s LEFT JOIN top ON l_suppkey = s_suppkey""")
def github_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls = "SELECT s_suppkey AS run_id, 0 AS src_seq, 'github_url' AS source_type, CASE WHEN s_suppkey % 5 = 4 THEN 'http://github.com/dev' || s_suppkey ELSE ' https://github.com/dev' || s_suppkey END AS content FROM supplier"
    users = """SELECT 'dev' || s_suppkey AS username, '{"name":"' || s_name || '","blog":"' || CASE s_suppkey % 3 WHEN 0 THEN ' me' || s_suppkey || '.example' WHEN 1 THEN 'http://me.example' ELSE '' END || '"}' AS profile FROM supplier WHERE s_suppkey % 7 <> 6"""
    languages = "SELECT 'dev' || l_suppkey AS username, l_orderkey * 10 + l_linenumber AS seq, CASE WHEN l_partkey % 13 <> 5 THEN 'Lang' || l_partkey % 13 END AS language FROM lineitem"
    raw = profiles.from_developer_urls(I.view(spark, sf_dir, urls), I.view(spark, sf_dir, users), I.view(spark, sf_dir, languages))
    return raw.select("run_id", "full_name", "portfolio_url", "github_url", F.array_join("skills_raw", ",").alias("skills"))


@query("""WITH n AS (SELECT user_id, event_type || '-' || event_id % 5 AS kind, count(*) AS n, min(event_id) AS first FROM events GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first) AS k FROM n)
  SELECT cast(user_id AS varchar) AS username, string_agg(kind, ',' ORDER BY k) AS languages FROM r WHERE k <= 10 GROUP BY user_id""")
def language_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The histogram operator over events of 25 kinds, with its own limit of ten."""
    rows = I.view(spark, sf_dir, "SELECT cast(user_id AS string) AS username, event_id AS seq, event_type || '-' || event_id % 5 AS language FROM events")
    return profiles.top_languages(rows).select("username", F.array_join("languages", ",").alias("languages"))


@query("""SELECT cast(c_custkey AS varchar) AS run_id, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'G' || c_custkey || ' Fam' END AS full_name, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE 'local' END AS headline,
    'https://linkedin.com/in/' || c_custkey AS linkedin_url FROM customer""")
def identity_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = """SELECT c_custkey AS run_id, 0 AS src_seq, 'linkedin_url' AS source_type, '{"given_name":"G' || c_custkey || '","family_name":"Fam","localizedHeadline":"local","profile_url":"https://linkedin.com/in/' || c_custkey || '"'
      || CASE WHEN c_custkey % 2 = 0 THEN ',"name":"' || c_name || '"' ELSE ',"name":""' END || CASE WHEN c_custkey % 3 = 0 THEN ',"headline":"' || c_mktsegment || '"' ELSE '' END || '}' AS content FROM customer"""
    return profiles.from_identity_profiles(I.view(spark, sf_dir, rows, deal=True)).select("run_id", "full_name", "headline", "linkedin_url")


def keyword_sql(alias: str, name: str) -> str:
    after = rf"($|[^\p{{L}}\p{{N}}_])" if re.match(r"\w", alias[-1]) else WORDCHAR
    return rf"CASE WHEN contains(low, '{alias}') AND regexp_matches(low, '(^|[^\p{{L}}\p{{N}}_]){re.escape(alias)}{after}') THEN '{name}' END"


def prose_sql(texts: str, phone: str) -> str:
    """CTEs ending in told: what is said in ``t`` (id, text). ``phone`` is the SQL of a candidate ``x`` in a text of ``region``."""
    strip = r"regexp_replace(x, '^\s+|\s+$', '', 'g')"
    region = "CASE " + " ".join(f"WHEN contains(low, '{k}') THEN '{v}'" for k, v in D.REGION_HINTS.items()) + f" ELSE '{D.DEFAULT_REGION}' END"
    return rf"""t AS (SELECT id, text, lower(text) AS low FROM ({texts})), found AS (SELECT id, {region} AS region,
      list_filter(list_transform(string_split(text, chr(10))[1:5], lambda x: {strip}), lambda x: regexp_full_match(x, '\p{{Lu}}\S*(\s+\p{{Lu}}\S*){{1,3}}') AND NOT regexp_matches(lower(x), 'experience|education|skills|resume|curriculum'))[1] AS full_name,
      regexp_extract_all(text, '{EMAIL_OK}') AS mails, list_filter(list_transform(regexp_extract_all(text, '[+(]?[\d\s\-().]{{7,20}}\d'), lambda x: {strip}), lambda x: length(x) >= 7)[1:5] AS tels,
      regexp_extract_all(text, '(?i)linkedin\.com/in/([\w\-]+)', 1)[1] AS li, list_filter(regexp_extract_all(text, '(?i)github\.com/([\w\-]+)', 1), lambda x: lower(x) NOT IN ('com', 'orgs', 'topics', 'trending'))[1] AS gh,
      list_filter(regexp_extract_all(text, '(?i)https?://\S+|www\.\S+'), lambda x: NOT contains(x, 'linkedin') AND NOT contains(x, 'github'))[1] AS portfolio_url, [{", ".join(keyword_sql(k, v) for k, v in D.SKILLS.items())}] AS names FROM t),
    mail AS (SELECT id, string_agg(m, '|' ORDER BY pos) AS emails FROM (SELECT id, lower(m) AS m, min(pos) AS pos FROM (SELECT id, unnest(mails) AS m, generate_subscripts(mails, 1) AS pos FROM found) GROUP BY ALL) GROUP BY id),
    tel AS (SELECT id, string_agg(coalesce({phone}, x), '|' ORDER BY pos) AS phones FROM (SELECT id, region, unnest(tels) AS x, generate_subscripts(tels, 1) AS pos FROM found) GROUP BY id),
    skill AS (SELECT id, string_agg(n, '|' ORDER BY pos) AS skills FROM (SELECT id, n, min(pos) AS pos FROM (SELECT id, unnest(names) AS n, generate_subscripts(names, 1) AS pos FROM found) WHERE n IS NOT NULL GROUP BY ALL) GROUP BY id),
    told AS (SELECT f.id, full_name, coalesce(emails, '') AS emails, coalesce(phones, '') AS phones, 'https://linkedin.com/in/' || li AS linkedin_url, 'https://github.com/' || gh AS github_url, portfolio_url, coalesce(skills, '') AS skills
      FROM found f LEFT JOIN mail USING (id) LEFT JOIN tel USING (id) LEFT JOIN skill USING (id))"""


@query(f"""WITH {prose_sql(I.SKILL_TEXTS.replace("SELECT doc_id, text", "SELECT doc_id AS id, text"), "NULL")}
  SELECT cast(id AS varchar) AS run_id, full_name, emails, phones, linkedin_url, github_url, skills FROM told""")
def notes_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.view(spark, sf_dir, f"SELECT doc_id AS run_id, 0 AS src_seq, 'recruiter_txt' AS source_type, text AS content FROM ({I.SKILL_TEXTS})", deal=True)
    joined = lambda c, field: F.array_join(field, "|").alias(c)
    return prose.from_notes(rows).select("run_id", "full_name", joined("emails", "emails"), joined("phones", "phones"), "linkedin_url", "github_url", joined("skills", "skills_raw"))


MONTHS_SQL = {k: f"'{v}'" for k, v in D.MONTHS.items()}


def date_sql(c: str) -> str:
    month = case_sql(rf"lower(regexp_extract({c}, '([A-Za-z]+)\s+(\d{{4}})', 1))", MONTHS_SQL, "NULL")
    return rf"""CASE WHEN trim({c}) = '' OR lower(trim({c})) IN ('present', 'current', 'now', 'ongoing') THEN NULL WHEN regexp_matches({c}, '\d{{4}}-\d{{2}}') THEN regexp_extract({c}, '(\d{{4}}-\d{{2}})', 1)
      WHEN regexp_matches({c}, '\d{{2}}/\d{{4}}') THEN regexp_extract({c}, '(\d{{2}})/(\d{{4}})', 2) || '-' || regexp_extract({c}, '(\d{{2}})/(\d{{4}})', 1)
      WHEN {month} IS NOT NULL THEN regexp_extract({c}, '([A-Za-z]+)\s+(\d{{4}})', 2) || '-' || {month} WHEN regexp_matches({c}, '\d{{4}}') THEN regexp_extract({c}, '(\d{{4}})', 1) || '-01' END"""


def header_sql(*sections: str) -> str:
    return "(length(line) < 60 AND regexp_matches(lower(line), '" + "|".join(w for s in sections for w in D.SECTIONS[s]) + "'))"


#: The lines of each resume, one empty line more, and what the rules ask of a line.
LINES = rf"""cut AS (SELECT run_id, unnest(string_split(content || chr(10), chr(10))) AS raw, generate_subscripts(string_split(content || chr(10), chr(10)), 1) AS pos FROM ({I.RESUMES})),
    lines AS (SELECT run_id, pos, pos = max(pos) OVER (PARTITION BY run_id) AS fin, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS line FROM cut),
    spans AS (SELECT *, regexp_extract(line, '{D.RANGE_PATTERN}', 0) AS span, regexp_extract(line, '{D.RANGE_PATTERN}', 1) AS since, regexp_extract(line, '{D.RANGE_PATTERN}', 2) AS until FROM lines)"""

#: The job rules, line by line: each step's rule decides what becomes of the job being read, and whether it is over.
JOB_RULES = rf"""{LINES},
    told_jobs AS (SELECT run_id, CAST(0 AS BIGINT) AS pos, false AS inside, false AS going, CAST(NULL AS VARCHAR) AS company, CAST(NULL AS VARCHAR) AS title, CAST(NULL AS VARCHAR) AS since, CAST(NULL AS VARCHAR) AS until, CAST(NULL AS VARCHAR) AS summary,
        false AS over, CAST(NULL AS STRUCT(company VARCHAR, title VARCHAR, since VARCHAR, until VARCHAR, summary VARCHAR)) AS job FROM ({I.RESUMES})
      UNION ALL
      SELECT run_id, pos, CASE rule WHEN 'enter' THEN true WHEN 'leave' THEN false ELSE inside END,
        CASE WHEN cleared THEN false WHEN rule IN ('dates', 'more') THEN true WHEN rule = 'name' THEN going OR contains(line, '|') OR NOT contains(lower(line), 'at ') OR at_fits ELSE going END,
        CASE WHEN cleared OR again THEN NULL WHEN rule <> 'name' THEN company WHEN contains(line, '|') THEN trim(string_split(line, '|')[2]) WHEN contains(lower(line), 'at ') THEN CASE WHEN at_fits THEN trim(regexp_extract(line, '(?i)^(.+?)\s+at\s+(.+)', 2)) ELSE company END
          WHEN contains(line, ',') THEN trim(substr(line, strpos(line, ',') + 1)) ELSE line END,
        CASE WHEN cleared THEN NULL WHEN rule = 'dates' THEN coalesce(nullif(trim(substr(line, 1, strpos(line, span) - 1), ' -|–—'), ''), CASE WHEN NOT again THEN title END) WHEN rule <> 'name' THEN title WHEN contains(line, '|') THEN trim(string_split(line, '|')[1])
          WHEN contains(lower(line), 'at ') THEN CASE WHEN at_fits THEN trim(regexp_extract(line, '(?i)^(.+?)\s+at\s+(.+)', 1)) ELSE title END WHEN contains(line, ',') THEN trim(string_split(line, ',')[1]) ELSE title END,
        CASE WHEN cleared THEN NULL WHEN rule = 'dates' THEN {date_sql("new_since")} ELSE since END, CASE WHEN cleared THEN NULL WHEN rule = 'dates' THEN {date_sql("new_until")} ELSE until END,
        CASE WHEN cleared OR again THEN NULL WHEN rule = 'more' AND bare <> '' THEN trim(coalesce(summary, '') || ' ' || bare) ELSE summary END,
        going AND (cleared OR again), {{'company': company, 'title': title, 'since': since, 'until': until, 'summary': summary}}
      FROM (SELECT *, rule IN ('blank', 'enter', 'leave') AS cleared, rule = 'dates' AND since IS NOT NULL AS again, regexp_matches(line, '(?i)^(.+?)\s+at\s+(.+)') AS at_fits, trim(regexp_replace(line, '^[•\-* ]+', '')) AS bare
        FROM (SELECT s.run_id, l.pos, inside, going, company, title, s.since, s.until, summary, line, span, l.since AS new_since, l.until AS new_until,
            CASE WHEN line = '' THEN 'blank' WHEN NOT inside AND {header_sql("experience")} THEN 'enter' WHEN inside AND {header_sql("education", "skills")} THEN 'leave' WHEN NOT inside THEN 'skip' WHEN span <> '' THEN 'dates'
              WHEN coalesce(company, '') = '' THEN 'name' ELSE 'more' END AS rule
          FROM told_jobs s JOIN spans l ON l.run_id = s.run_id AND l.pos = s.pos + 1))),
    parsed AS (SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY pos) - 1 AS pos, job FROM told_jobs WHERE over)"""
PARSED_YEARS = f"""spent AS (SELECT run_id, sum(CASE WHEN job.until IS NULL THEN {I.AS_OF_MONTHS} ELSE cast(substr(job.until, 1, 4) AS integer) * 12 + cast(substr(job.until, 6, 2) AS integer) END - cast(substr(job.since, 1, 4) AS integer) * 12 - cast(substr(job.since, 6, 2) AS integer)) AS m
      FROM parsed WHERE job.since <> '' GROUP BY run_id), years AS (SELECT run_id, CASE WHEN m > 0 THEN round_even(m / 12.0, 1) END AS years FROM spent)"""

DEGREE_SQL = r"regexp_matches(lower(line), '(^|[^a-z0-9_])(bachelor|master|phd|b\.s|m\.s|b\.e|m\.e|b\.tech|m\.tech|mba|b\.a|m\.a|associate)($|[^a-z0-9_])')"
#: The education rules, line by line: an institution, then the line with its degree.
COURSE_RULES = rf"""{LINES},
    told_courses AS (SELECT run_id, CAST(0 AS BIGINT) AS pos, false AS inside, false AS going, false AS detail, CAST(NULL AS VARCHAR) AS institution, CAST(NULL AS VARCHAR) AS degree, CAST(NULL AS VARCHAR) AS field, CAST(NULL AS INTEGER) AS end_year,
        false AS over, CAST(NULL AS STRUCT(institution VARCHAR, degree VARCHAR, field VARCHAR, end_year INTEGER)) AS course FROM ({I.RESUMES})
      UNION ALL
      SELECT run_id, pos, CASE rule WHEN 'enter' THEN true WHEN 'leave' THEN false ELSE inside END, CASE WHEN rule IN ('enter', 'leave', 'end') THEN false WHEN rule IN ('place', 'degree') THEN true ELSE going END,
        CASE WHEN rule IN ('enter', 'leave') THEN detail AND NOT going WHEN rule = 'place' THEN true WHEN rule = 'degree' THEN false ELSE detail END,
        CASE WHEN rule IN ('enter', 'leave') THEN NULL WHEN rule = 'place' THEN trim(string_split(line, ',')[1]) ELSE institution END,
        CASE WHEN rule IN ('enter', 'leave', 'place') THEN NULL WHEN rule = 'degree' THEN trim(string_split(line, ',')[1]) ELSE degree END,
        CASE WHEN rule IN ('enter', 'leave', 'place') THEN NULL WHEN rule = 'degree' AND contains(line, ',') AND {DEGREE_SQL} THEN trim(substr(line, strpos(line, ',') + 1)) ELSE field END,
        CASE WHEN rule IN ('enter', 'leave', 'place') THEN NULL WHEN rule = 'degree' THEN coalesce(cast(regexp_extract_all(line, '(^|[^\p{{L}}\p{{N}}_])((?:19|20)\d{{2}})\b', 2)[-1] AS INTEGER), end_year) ELSE end_year END,
        going AND rule IN ('enter', 'leave', 'place', 'end'), {{'institution': institution, 'degree': degree, 'field': field, 'end_year': end_year}}
      FROM (SELECT s.*  EXCLUDE (pos), l.pos, line, CASE WHEN fin THEN 'end' WHEN line = '' THEN 'blank' WHEN NOT inside AND {header_sql("education")} THEN 'enter' WHEN inside AND {header_sql("experience", "skills")} THEN 'leave' WHEN NOT inside THEN 'skip' WHEN NOT detail THEN 'place' ELSE 'degree' END AS rule
        FROM told_courses s JOIN lines l ON l.run_id = s.run_id AND l.pos = s.pos + 1)),
    studied AS (SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY pos) - 1 AS pos, course FROM told_courses WHERE over)"""


@query(f"""WITH RECURSIVE {JOB_RULES}, {PARSED_YEARS}, {COURSE_RULES.replace(LINES + ",", "", 1)}, {prose_sql(f"SELECT run_id AS id, content AS text FROM ({I.RESUMES})", f"CASE WHEN region = 'GB' AND x NOT LIKE '+%' THEN CASE WHEN regexp_full_match(regexp_replace(x, '[^0-9]', '', 'g'), '0?([1-35789][0-9]{{9}}|[18][0-9]{{8}})') THEN '+44' || regexp_replace(regexp_replace(x, '[^0-9]', '', 'g'), '^0', '') END ELSE {phone_sql('x')} END")},
    worked AS (SELECT run_id, string_agg(coalesce(job.company, '') || '/' || coalesce(job.title, ''), '|' ORDER BY pos) AS jobs FROM parsed GROUP BY run_id), learned AS (SELECT run_id, string_agg(coalesce(course.institution, ''), '|' ORDER BY pos) AS courses FROM studied GROUP BY run_id)
  SELECT cast(id AS varchar) AS run_id, full_name, emails, phones, linkedin_url, github_url, told.portfolio_url, skills, years AS years_experience, coalesce(jobs, '') AS jobs, coalesce(courses, '') AS courses
  FROM told LEFT JOIN years ON years.run_id = id LEFT JOIN worked ON worked.run_id = id LEFT JOIN learned ON learned.run_id = id""")
def resume_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.view(spark, sf_dir, f"SELECT run_id, 0 AS src_seq, 'resume_docx' AS source_type, content FROM ({I.RESUMES})", deal=True)
    joined = lambda c, field: F.array_join(field, "|").alias(c)
    said = lambda c: F.coalesce(c, F.lit(""))
    jobs = F.transform("experience", lambda j: F.concat(said(j["company"]), F.lit("/"), said(j["title"])))
    courses = F.transform("education", lambda c: said(c["institution"]))
    return prose.from_resumes(rows, I.AS_OF).select(
        "run_id", "full_name", joined("emails", "emails"), joined("phones", "phones"), "linkedin_url", "github_url", "portfolio_url", joined("skills", "skills_raw"), "years_experience", joined("jobs", jobs), joined("courses", courses)
    )


@query(f"""SELECT cast(run_id AS varchar) AS run_id, src_seq, source_type, full_name, email, phone, location_raw, headline, array_to_string(list_filter(list_transform(string_split(skills, ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS skills FROM ({I.SOURCES})""")
def source_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = I.sources(spark, sf_dir)
    return raw.select("run_id", "src_seq", "source_type", "full_name", F.get("emails", 0).alias("email"), F.get("phones", 0).alias("phone"), "location_raw", "headline", F.array_join("skills_raw", "|").alias("skills"))


# ---- functions ----


@query(f"SELECT run_id, {email_sql('email')} AS email FROM ({I.CONTACTS})")
def email_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.view(spark, sf_dir, I.CONTACTS, deal=True).select("run_id", N.email(F.col("email")).alias("email"))


@query(f"SELECT DISTINCT doc_id, lower(unnest(regexp_extract_all(text, '{EMAIL_OK}'))) AS email FROM documents")
def email_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.view(spark, sf_dir, "SELECT * FROM documents", deal=True).select("doc_id", F.explode(N.emails_in_text(F.col("text"))).alias("email"))


@query(r"""WITH c AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '[+(]?[\d\s\-().]{7,20}\d'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: length(x) >= 7)[1:5] AS l FROM documents)
  SELECT doc_id, generate_subscripts(l, 1) AS pos, unnest(l) AS candidate FROM c""")
def phone_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.view(spark, sf_dir, "SELECT * FROM documents", deal=True).select("doc_id", F.posexplode(F.slice(T.phone_candidates(F.col("text")), 1, 5)).alias("pos", "candidate"))
    return rows.select("doc_id", (F.col("pos") + 1).cast("long").alias("pos"), "candidate")


@query(f"SELECT run_id, phone, {phone_sql('phone')} AS e164 FROM ({I.CONTACTS})")
def phone_e164(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.view(spark, sf_dir, I.CONTACTS, deal=True).select("run_id", "phone", N.phone(F.col("phone")).alias("e164"))


@query("SELECT doc_id, " + "CASE " + " ".join(f"WHEN contains(lower(text), '{k}') THEN '{v}'" for k, v in D.REGION_HINTS.items()) + f" ELSE '{D.DEFAULT_REGION}' END AS region FROM documents")
def phone_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.view(spark, sf_dir, "SELECT * FROM documents", deal=True).select("doc_id", T.region_of(F.col("text")).alias("region"))


MONTH_SQL = case_sql(r"lower(regexp_extract(raw, '([A-Za-z]+)\s+(\d{4})', 1))", {k: f"'{v}'" for k, v in D.MONTHS.items()}, "NULL")


@query(rf"""SELECT o_orderkey, CASE WHEN trim(raw) = '' OR lower(trim(raw)) IN ('present', 'current', 'now', 'ongoing') THEN NULL
    WHEN regexp_matches(raw, '\d{{4}}-\d{{2}}') THEN regexp_extract(raw, '(\d{{4}}-\d{{2}})', 1)
    WHEN regexp_matches(raw, '\d{{2}}/\d{{4}}') THEN regexp_extract(raw, '(\d{{2}})/(\d{{4}})', 2) || '-' || regexp_extract(raw, '(\d{{2}})/(\d{{4}})', 1)
    WHEN {MONTH_SQL} IS NOT NULL THEN regexp_extract(raw, '([A-Za-z]+)\s+(\d{{4}})', 2) || '-' || {MONTH_SQL}
    WHEN regexp_matches(raw, '\d{{4}}') THEN regexp_extract(raw, '(\d{{4}})', 1) || '-01' END AS date FROM ({I.DATES})""")
def date_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.view(spark, sf_dir, I.DATES, deal=True).select("o_orderkey", N.date(F.col("raw")).alias("date"))


@query(f"SELECT p.p_partkey, coalesce(dict.name, {title_sql('trim(p.raw)')}) AS skill FROM ({I.SKILL_NAMES}) p LEFT JOIN {SKILL_TABLE} ON dict.alias = lower(trim(p.raw))")
def skill_canonicalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.view(spark, sf_dir, I.SKILL_NAMES, deal=True).select("p_partkey", N.skill(F.col("raw")).alias("skill"))


@query(f"""WITH t AS (SELECT doc_id, lower(text) AS low FROM ({I.SKILL_TEXTS})), f AS (SELECT doc_id, unnest([{", ".join(keyword_sql(k, v) for k, v in D.SKILLS.items())}]) AS skill FROM t)
  SELECT DISTINCT doc_id, skill FROM f WHERE skill IS NOT NULL""")
def skill_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.view(spark, sf_dir, I.SKILL_TEXTS, deal=True).select("doc_id", F.explode(T.keyword_skills(F.col("text"))).alias("skill"))


@query(f"WITH {location_sql(I.LOCATIONS)} SELECT i.id, l.city, l.region, l.country FROM ({I.LOCATIONS}) i JOIN loc l ON l.raw = i.raw")
def location_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.view(spark, sf_dir, I.LOCATIONS, deal=True).select("id", N.location(F.col("raw")).alias("l")).select("id", "l.*")


@query(rf"""WITH f AS (SELECT doc_id, regexp_extract_all(text, '(?i)linkedin\.com/in/([\w\-]+)', 1)[1] AS li, list_filter(regexp_extract_all(text, '(?i)github\.com/([\w\-]+)', 1), lambda x: lower(x) NOT IN ('com', 'orgs', 'topics', 'trending'))[1] AS gh,
      list_filter(regexp_extract_all(text, '(?i)https?://\S+|www\.\S+'), lambda x: NOT contains(x, 'linkedin') AND NOT contains(x, 'github'))[1] AS url FROM ({I.SKILL_TEXTS}))
  SELECT doc_id, 'https://linkedin.com/in/' || li AS linkedin_url, 'https://github.com/' || gh AS github_url, url AS portfolio_url FROM f""")
def handles(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return I.view(spark, sf_dir, I.SKILL_TEXTS, deal=True).select("doc_id", T.linkedin_url(t).alias("linkedin_url"), T.github_url(t).alias("github_url"), T.portfolio_url(t).alias("portfolio_url"))


@query(r"""SELECT page_id, list_filter(regexp_extract_all(html, '(?i)https?://\S+|www\.\S+'), lambda x: NOT contains(x, 'linkedin') AND NOT contains(x, 'github'))[1] AS portfolio_url FROM pages""")
def portfolio_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.view(spark, sf_dir, "SELECT * FROM pages", deal=True).select("page_id", T.portfolio_url(F.col("html")).alias("portfolio_url"))


@query(r"""SELECT doc_id, list_filter(list_transform(string_split(text, chr(10))[1:5], lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')),
    lambda x: regexp_full_match(x, '\p{Lu}\S*(\s+\p{Lu}\S*){1,3}') AND NOT regexp_matches(lower(x), 'experience|education|skills|resume|curriculum'))[1] AS name FROM documents""")
def name_heuristic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.view(spark, sf_dir, "SELECT * FROM documents", deal=True).select("doc_id", T.name(F.col("text")).alias("name"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE length(line) < 60 AND regexp_matches(lower(line), 'experience|work history|employment|career')) AS headers,
    count(*) FILTER (WHERE regexp_matches(lower(line), '(^|[^a-z0-9_])(bachelor|master|phd|b\\.s|m\\.s|b\\.e|m\\.e|b\\.tech|m\\.tech|mba|b\\.a|m\\.a|associate)($|[^a-z0-9_])')) AS degrees FROM l GROUP BY doc_id""")
def section_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = I.view(spark, sf_dir, "SELECT * FROM documents", deal=True).select("doc_id", F.explode(T.lines_of(F.col("text"))).alias("line"))
    return lines.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if(T.is_header(F.col("line"), "experience")).alias("headers"), F.count_if(T.has_degree(F.col("line"))).alias("degrees"))


@query(f"""WITH RECURSIVE {JOB_RULES} SELECT cast(run_id AS varchar) AS run_id, cast(pos AS integer) AS pos, job.company AS company, job.title AS title, job.since AS job_start, job.until AS job_end, job.summary AS summary FROM parsed""")
def experience_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.view(spark, sf_dir, I.RESUMES, deal=True).select(F.col("run_id").cast("string").alias("run_id"), F.posexplode(T.jobs(F.col("content"))).alias("pos", "j"))
    return rows.select("run_id", "pos", "j.company", "j.title", F.col("j.start").alias("job_start"), F.col("j.end").alias("job_end"), "j.summary")


@query(f"""WITH RECURSIVE {COURSE_RULES} SELECT cast(run_id AS varchar) AS run_id, cast(pos AS integer) AS pos, course.institution AS institution, course.degree AS degree, course.field AS field, course.end_year AS end_year FROM studied""")
def education_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.view(spark, sf_dir, I.RESUMES, deal=True).select(F.col("run_id").cast("string").alias("run_id"), F.posexplode(T.courses(F.col("content"))).alias("pos", "c"))
    return rows.select("run_id", "pos", "c.institution", "c.degree", "c.field", "c.end_year")


@query(f"""WITH RECURSIVE {JOB_RULES}, {PARSED_YEARS} SELECT cast(r.run_id AS varchar) AS run_id, years FROM ({I.RESUMES}) r LEFT JOIN years y ON y.run_id = r.run_id""")
def resume_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.view(spark, sf_dir, I.RESUMES, deal=True).select(F.col("run_id").cast("string").alias("run_id"), T.years_of(T.jobs(F.col("content")), I.AS_OF, only_forward=False).alias("years"))


# ---- merge ----


def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.merge(I.sources(spark, sf_dir), I.AS_OF)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles_of(I.sources(spark, sf_dir), I.AS_OF)


@query(f"""WITH {SRC}, w AS (SELECT run_id, {winner_sql("full_name")} AS full_name, {winner_sql("headline")} AS headline, {winner_sql("location_raw")} AS raw FROM src GROUP BY run_id), {location_sql("SELECT raw FROM w")}
  SELECT cast(w.run_id AS varchar) AS run_id, w.full_name, w.headline, loc.city, loc.region, loc.country FROM w LEFT JOIN loc ON loc.raw = w.raw""")
def scalar_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merged(spark, sf_dir).select("run_id", "full_name", "headline", "location.*")


@query(f"""WITH {SRC}, held AS (SELECT run_id, ord, source_type, unnest(['full_name', 'location_raw', 'headline']) AS field, unnest([full_name, location_raw, headline]) AS v FROM src),
    r AS (SELECT *, row_number() OVER w AS k, first_value(source_type) OVER w AS top FROM held WHERE trim(coalesce(v, '')) <> '' WINDOW w AS (PARTITION BY run_id, field ORDER BY ord))
  SELECT cast(run_id AS varchar) AS run_id, CASE WHEN k = 1 AND field = 'location_raw' THEN 'location' ELSE field END AS field, source_type AS source, CASE WHEN k = 1 AND field = 'location_raw' THEN 'direct+normalize' ELSE 'direct' END AS method,
    CASE WHEN k > 1 THEN 'conflict: overridden by ' || top END AS note FROM r""")
def conflict_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = merged(spark, sf_dir).select("run_id", F.explode("provenance").alias("p")).select("run_id", "p.*")
    return told.filter(F.col("field").isin("full_name", "location_raw", "location", "headline"))


def union_of(spark: SparkSession, sf_dir: str, field: str) -> DataFrame:
    m = merged(spark, sf_dir)
    source = F.get(F.filter("provenance", lambda p: p["field"] == field), 0)["source"]
    return m.filter(F.size(field) > 0).select("run_id", F.array_join(field, "|").alias("vals"), source.alias("sources"))


@query(f"WITH {SRC}, {EMAILS} SELECT cast(run_id AS varchar) AS run_id, vals, sources FROM emails")
def email_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return union_of(spark, sf_dir, "emails")


@query(f"WITH {SRC}, {PHONES} SELECT cast(run_id AS varchar) AS run_id, vals, sources FROM phones")
def phone_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return union_of(spark, sf_dir, "phones")


@query(f"WITH {SRC}, {SKILLS} SELECT cast(run_id AS varchar) AS run_id, row_number() OVER (PARTITION BY run_id ORDER BY nth) - 1 AS pos, name, sources FROM skills")
def skill_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = merged(spark, sf_dir).select("run_id", F.posexplode("skills").alias("pos", "s"))
    return rows.select("run_id", F.col("pos").cast("long").alias("pos"), "s.name", F.array_join("s.sources", ",").alias("sources"))


@query(f"{SUMMARY} SELECT run_id, candidate_id FROM whole")
def candidate_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merged(spark, sf_dir).select("run_id", "candidate_id")


JOBS_SQL = f"""jobs AS (SELECT run_id, lower(trim(company)) AS c, lower(trim(title)) AS t, min(seq) AS pos, arg_min({{'company': company, 'title': title, 'job_start': job_start, 'job_end': job_end}}, (CASE WHEN job_start IS NULL THEN 1 ELSE 0 END) * 1000000000 + seq) AS j
    FROM ({I.JOBS}) GROUP BY ALL)"""


@query(f"WITH {JOBS_SQL} SELECT cast(run_id AS varchar) AS run_id, row_number() OVER (PARTITION BY run_id ORDER BY pos) - 1 AS pos, j.company AS company, j.title AS title, j.job_start AS job_start, j.job_end AS job_end FROM jobs")
def experience_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = M.merge(I.job_records(spark, sf_dir), I.AS_OF).select("run_id", F.posexplode("experience").alias("pos", "j"))
    return rows.select("run_id", F.col("pos").cast("long").alias("pos"), "j.company", "j.title", F.col("j.start").alias("job_start"), F.col("j.end").alias("job_end"))


def months_sql(c: str) -> str:
    return f"(cast(substr({c}, 1, 4) AS integer) * 12 + cast(substr({c}, 6, 2) AS integer))"


@query(f"""WITH {JOBS_SQL}, m AS (SELECT run_id, sum(greatest(0, CASE WHEN j.job_end IS NULL THEN {I.AS_OF_MONTHS} ELSE {months_sql("j.job_end")} END - {months_sql("j.job_start")})) FILTER (WHERE j.job_start IS NOT NULL) AS m FROM jobs GROUP BY run_id)
  SELECT cast(run_id AS varchar) AS run_id, CASE WHEN m > 0 THEN round_even(m / 12.0, 1) END AS years FROM m""")
def years_experience(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.merge(I.job_records(spark, sf_dir), I.AS_OF).select("run_id", F.col("years_experience").alias("years"))


@query(f"""WITH e AS (SELECT *, row_number() OVER (PARTITION BY run_id, company, title ORDER BY seq) AS k FROM ({I.JOBS}))
  SELECT cast(run_id AS varchar) AS run_id, company AS institution, title AS degree, job_start AS field, cast(substr(job_end, 1, 4) AS integer) AS end_year FROM e WHERE k = 1""")
def education_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.merge(I.course_records(spark, sf_dir), I.AS_OF).select("run_id", F.inline("education"))


@query("SELECT cast(c_custkey AS varchar) AS run_id, CASE c_custkey % 4 WHEN 0 THEN 'https://a.example' WHEN 1 THEN 'https://a.example|https://b.example' WHEN 2 THEN 'https://b.example' ELSE '' END AS other FROM customer")
def other_url_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.lit("https://a.example"), F.lit("https://b.example")
    rows = I.view(spark, sf_dir, "SELECT c_custkey AS run_id, s AS src_seq, CASE s WHEN 0 THEN 'csv' ELSE 'ats_json' END AS source_type FROM customer CROSS JOIN (SELECT explode(array(0, 1)) AS s)")
    k, csv = F.col("run_id") % 4, F.col("source_type") == "csv"
    urls = F.when(k == 0, F.array(a, F.lit(""), a)).when((k == 1) & csv, F.array(b, a)).when(k == 1, F.array(a)).when((k == 2) & csv, F.array(b))
    return M.merge(raw_with(rows, urls), I.AS_OF).select("run_id", F.array_join("links.other", "|").alias("other"))


def raw_with(rows: DataFrame, urls: Column) -> DataFrame:
    from amalgam.sources.schema import raw_records

    return raw_records(rows, other_urls=urls)


# ---- scores ----


@query(f"{FIELDS} SELECT run_id, " + ", ".join(f"round(cast({f} AS double), 6) AS {f}" for f in D.FIELD_WEIGHTS) + " FROM scores")
def field_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merged(spark, sf_dir).select("run_id", *[F.round(s, 6).alias(f) for f, s in C.field_scores().items()])


@query(f"{FIELDS} SELECT run_id, {OVERALL} AS overall_confidence FROM scores")
def overall_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("run_id", "overall_confidence")


@query(f"""WITH {SRC}, {SKILLS} SELECT cast(run_id AS varchar) AS run_id, name, round(cast(least(1.0, list_max(list_transform(string_split(sources, ','), lambda s: {base_sql("s", D.UNKNOWN_SOURCE)})) * {D.KEYWORD}
    + CASE WHEN contains(sources, ',') THEN {D.SEVERAL} ELSE 0.0 END) AS double), 6) AS confidence FROM skills""")
def skill_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("run_id", F.inline("skills")).select("run_id", "name", F.round("confidence", 6).alias("confidence"))


@query(f"{FIELDS}, o AS (SELECT run_id, {OVERALL} AS s FROM scores) SELECT run_id, CASE WHEN round(s * 100) >= 80 THEN 'high' WHEN round(s * 100) >= 50 THEN 'mid' ELSE 'low' END AS badge FROM o")
def confidence_badge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("run_id", N.badge(F.col("overall_confidence")).alias("badge"))


# ---- projection ----

CONFIG = {
    "fields": [
        {"path": "name", "from": "full_name", "normalize": "lowercase"}, {"path": "mail", "from": "emails[0]"}, {"path": "phone", "from": "phones[0]", "normalize": "E164"},
        {"path": "country", "from": "location.country"}, {"path": "top", "from": "skills[].name", "type": "string[]", "normalize": "canonical"}, {"path": "nowhere", "from": "a[0].b"},
    ],
    "include_confidence": True,
}


@query(f"""{SUMMARY}, {location_sql("SELECT place AS raw FROM whole")}, tops AS (SELECT cast(run_id AS varchar) AS run_id, string_agg(coalesce(d2.name, {title_sql("s.name")}), '|' ORDER BY nth) AS top FROM skills s LEFT JOIN {values(D.SKILLS, "d2(i, alias, name)")} ON d2.alias = lower(s.name) GROUP BY run_id)
  SELECT w.run_id, lower(full_name) AS name, email AS mail, nullif(string_split(coalesce(phones, ''), '|')[1], '') AS phone, loc.country AS country, t.top AS top, CAST(NULL AS varchar) AS nowhere, overall_confidence AS _confidence
  FROM whole w LEFT JOIN loc ON loc.raw = w.place LEFT JOIN tops t ON t.run_id = w.run_id""")
def project_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = project(scored(spark, sf_dir), CONFIG)
    return out.select("run_id", "name", "mail", "phone", "country", F.array_join("top", "|").alias("top"), "nowhere", "_confidence")


@query(f"""{SUMMARY} SELECT run_id, CASE WHEN headline IS NULL THEN 'headline' ELSE '' END AS omitted,
    array_to_string(list_filter([CASE WHEN headline IS NULL THEN 'Field ''headline'' (from ''headline'') is required but resolved to null/empty' END, CASE WHEN email IS NULL THEN 'Field ''mail'' (from ''emails[0]'') is required but resolved to null/empty' END], lambda x: x IS NOT NULL), ';') AS errors FROM whole""")
def missing_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = [{"path": "headline"}, {"path": "mail", "from": "emails[0]"}]
    s = scored(spark, sf_dir)
    told = project(s, {"fields": fields, "on_missing": "error"}).select("run_id", F.array_join("_errors", ";").alias("errors"))
    omitted = project(s, {"fields": fields[:1], "on_missing": "omit"}).select("run_id", F.array_join("_omitted", ",").alias("omitted"))
    return omitted.join(told, "run_id")


@query(f"""{SUMMARY} SELECT run_id, CASE WHEN headline IS NULL THEN 'Validation error at ''$'': ''headline'' is a required property' ELSE '' END AS errors, CAST(full_name IS NOT NULL AS integer) AS named FROM whole""")
def validate_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = project(scored(spark, sf_dir), {"fields": [{"path": "headline", "required": True}, {"path": "full_name"}], "on_missing": "omit", "include_confidence": False})
    return out.select("run_id", F.array_join("_errors", ";").alias("errors"), F.col("full_name").isNotNull().cast("int").alias("named"))


@query(f"""{SUMMARY}, k AS (SELECT run_id, candidate_id, cast(run_id AS bigint) % 9 AS k, phones IS NOT NULL AS has_phone FROM whole)
  SELECT run_id, CASE WHEN k <> 7 THEN candidate_id END AS candidate_id, k NOT IN (1, 2, 4, 7) AND NOT (k = 5 AND has_phone) AS valid,
    'Validation error at ' || CASE WHEN k = 7 THEN '''$.candidate_id'': None is not of type ''string''' WHEN k = 1 THEN '''$.emails'': None is not of type ''array''' WHEN k = 2 THEN '''$.links'': None is not of type ''object'''
      WHEN k = 4 THEN '''$.overall_confidence'': None is not of type ''number''' WHEN k = 5 AND has_phone THEN '''$.phones[1]'': None is not of type ''string''' END AS error FROM k""")
def validate_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles of which some have lost a field or hold a null in a list."""
    k = F.col("run_id").cast("long") % 9
    holed = F.when((k == 5) & (F.size("phones") > 0), F.concat(F.slice("phones", 1, 1), F.array(F.lit(None).cast("string")))).otherwise(F.col("phones"))
    lost = scored(spark, sf_dir).withColumns({"candidate_id": F.when(k != 7, F.col("candidate_id")), "emails": F.when(k != 1, F.col("emails")), "links": F.when(k != 2, F.col("links")), "phones": holed, "overall_confidence": F.when(k != 4, F.col("overall_confidence"))})
    return validate(lost).select("run_id", "candidate_id", F.col("_valid").alias("valid"), F.col("_error").alias("error"))


# ---- store ----


def halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Existing and incoming profiles of the same people: their table rows and what HR systems say, under the former's id."""
    raw = I.sources(spark, sf_dir)
    one = profiles_of(raw.filter("source_type = 'csv'"), I.AS_OF)
    two = profiles_of(raw.filter("source_type = 'ats_json'"), I.AS_OF)
    ids = one.select("run_id", F.col("candidate_id").alias("_id"))
    two = two.join(ids, "run_id").withColumn("candidate_id", F.col("_id")).drop("_id")
    return one.drop("run_id"), two.drop("run_id")


HALVES = f"""{SRC}, {EMAILS.replace("FROM src", "FROM src WHERE source_type = 'csv'").replace("WHERE source_type = 'csv' WHERE", "WHERE source_type = 'csv' AND")},
    a AS (SELECT s.run_id, s.full_name, s.headline, substr(md5(coalesce(string_split(e.vals, '|')[1], '') || s.full_name), 1, 16) AS candidate_id, string_split(e.vals, '|')[1] AS email FROM src s LEFT JOIN emails e ON e.run_id = s.run_id WHERE s.source_type = 'csv'),
    b AS (SELECT run_id, full_name, headline, {email_sql("email")} AS email FROM src WHERE source_type = 'ats_json')"""
FOLDED = f"""WITH {HALVES} SELECT a.candidate_id, a.full_name, coalesce(nullif(trim(a.headline), ''), nullif(trim(b.headline), '')) AS headline,
    concat_ws('|', a.email, CASE WHEN b.email <> coalesce(a.email, '') THEN b.email END) AS emails FROM a LEFT JOIN b ON a.run_id = b.run_id"""


@query(FOLDED)
def fold_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold_pairs(*halves(spark, sf_dir), I.AS_OF).select("candidate_id", "full_name", "headline", F.array_join("emails", "|").alias("emails"))


@query(FOLDED)
def fold_submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    one, two = halves(spark, sf_dir)
    both = one.withColumn("submitted_at", F.lit(1)).unionByName(two.withColumn("submitted_at", F.lit(2)))
    return fold(both, I.AS_OF).select("candidate_id", "full_name", "headline", F.array_join("emails", "|").alias("emails"))


STORED = f"""{SUMMARY}, stored AS (SELECT w.candidate_id, w.full_name, w.overall_confidence, o.latest AS created_at FROM whole w JOIN (SELECT cast(o_custkey AS varchar) AS run_id, max(o_orderdate) AS latest FROM orders GROUP BY o_custkey) o ON o.run_id = w.run_id)"""


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = I.view(spark, sf_dir, "SELECT cast(o_custkey AS string) AS run_id, max(o_orderdate) AS created_at FROM orders GROUP BY o_custkey")
    return scored(spark, sf_dir).join(last, "run_id").select("candidate_id", "full_name", "overall_confidence", "created_at")


@query(f"{STORED} SELECT * FROM stored")
def list_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_candidates(stored(spark, sf_dir))


@query(f"{STORED} SELECT * FROM stored WHERE candidate_id = (SELECT min(candidate_id) FROM stored) ORDER BY created_at DESC LIMIT 1")
def get_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored(spark, sf_dir)
    return stored_candidate(rows, rows.agg(F.min("candidate_id")).first()[0])


@query(f"""{SUMMARY}, folders AS (SELECT cast(c_custkey AS varchar) AS folder FROM customer UNION SELECT 'empty' || n_nationkey FROM nation),
    done AS (SELECT f.folder, w.candidate_id, w.overall_confidence, CASE WHEN w.run_id IS NULL THEN 'skipped' WHEN w.headline IS NULL THEN 'error' ELSE 'ok' END AS status FROM folders f LEFT JOIN whole w ON w.run_id = f.folder)
  SELECT folder, status, candidate_id, overall_confidence FROM done""")
def batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored(spark, sf_dir)
    errors = F.when(F.col("headline").isNull(), F.array(F.lit("no headline"))).otherwise(F.array().cast("array<string>"))
    folders = I.view(spark, sf_dir, "SELECT cast(c_custkey AS string) AS run_id FROM customer UNION SELECT 'empty' || n_nationkey FROM nation")
    return summary(s.withColumn("_errors", errors).withColumn("error", F.lit(None).cast("string")), folders).drop("errors")


@query(f"""{SUMMARY}, d AS (SELECT CASE WHEN headline IS NULL THEN 'error' ELSE 'ok' END AS status FROM whole) SELECT count(*) AS total, count(*) FILTER (WHERE status = 'ok') AS succeeded FROM d""")
def batch_ok_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).agg(F.count("*").alias("total"), F.count_if(F.col("headline").isNotNull()).alias("succeeded"))


#: The same machinery over what is in the items; then each run's warnings and its readers' errors.
ITEM_SUMMARY = SUMMARY.replace(I.SOURCES, I.ITEM_RECORDS)
ITEM_PROFILES = f"""{ITEM_SUMMARY}, {location_sql("SELECT place AS raw FROM whole")}, tops AS (SELECT cast(run_id AS varchar) AS run_id, string_agg(coalesce(d2.name, {title_sql("s.name")}), '|' ORDER BY nth) AS top FROM skills s LEFT JOIN {values(D.SKILLS, "d2(i, alias, name)")} ON d2.alias = lower(s.name) GROUP BY run_id),
    runs AS (SELECT c_custkey, cast(c_custkey AS varchar) AS run_id, CASE WHEN c_custkey % 19 = 1 THEN 'Unknown source type: archive.tar.gz' ELSE '' END AS warnings, CASE WHEN c_custkey % 23 = 5 THEN 'All extractors failed' END AS error,
      concat_ws(';', CASE WHEN c_custkey % 23 = 5 THEN 'Extractor csv failed: its content could not be read' END, CASE WHEN c_custkey % 17 = 3 THEN 'Extractor resume_docx failed: its content could not be read' END) AS read_errors FROM customer)"""


@query(f"""{ITEM_PROFILES} SELECT r.run_id, r.error, r.warnings, concat_ws(';', nullif(read_errors, ''), CASE WHEN r.error IS NULL AND headline IS NULL THEN 'Validation error at ''$'': ''headline'' is a required property' END) AS errors,
    lower(full_name) AS name, email AS mail, nullif(string_split(coalesce(phones, ''), '|')[1], '') AS phone, loc.country AS country, coalesce(t.top, '') AS top, headline, overall_confidence AS _confidence
  FROM runs r LEFT JOIN whole w ON w.run_id = r.run_id LEFT JOIN loc ON loc.raw = w.place LEFT JOIN tops t ON t.run_id = r.run_id""")
def end_to_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of text, detected, read, merged, scored and projected to a configuration's fields, with every reader's error."""
    fields = [*CONFIG["fields"][:5], {"path": "headline", "required": True}]
    out = consolidate(I.view(spark, sf_dir, I.ITEMS, deal=True), I.AS_OF, {"fields": fields, "on_missing": "omit"})
    return out.select("run_id", "error", F.array_join("_warnings", ";").alias("warnings"), F.array_join("_errors", ";").alias("errors"), "name", "mail", "phone", "country", F.coalesce(F.array_join("top", "|"), F.lit("")).alias("top"), "headline", "_confidence")


@query(f"""{ITEM_PROFILES} SELECT r.run_id AS folder, CASE WHEN r.error IS NOT NULL OR read_errors <> '' THEN 'error' ELSE 'ok' END AS status, w.candidate_id, w.overall_confidence, read_errors AS errors FROM runs r LEFT JOIN whole w ON w.run_id = r.run_id
  UNION ALL SELECT 'empty' || n_nationkey, 'skipped', NULL, NULL, '' FROM nation""")
def batch_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch summary over items of text with their readers' own errors."""
    results = consolidate(I.view(spark, sf_dir, I.ITEMS, deal=True), I.AS_OF)
    folders = I.view(spark, sf_dir, "SELECT cast(c_custkey AS string) AS run_id FROM customer UNION SELECT 'empty' || n_nationkey FROM nation")
    return summary(results, folders).withColumn("errors", F.coalesce(F.array_join("errors", ";"), F.lit("")))


@query(f"{SUMMARY} SELECT run_id, candidate_id, full_name, headline, coalesce(emails, '') AS emails, coalesce(phones, '') AS phones, overall_confidence FROM whole")
def consolidate_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of it: raw records to scored profiles in one plan with one exchange by run."""
    return scored(spark, sf_dir).select("run_id", "candidate_id", "full_name", "headline", F.array_join("emails", "|").alias("emails"), F.array_join("phones", "|").alias("phones"), "overall_confidence")
