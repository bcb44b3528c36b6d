"""Deterministic inputs for the queries, derived from the driver's tables in SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from amalgam.functions.normalize import comma_list
from amalgam.sources.schema import raw_records

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
AS_OF = "2026-06"
AS_OF_MONTHS = 2026 * 12 + 6

CONTACTS = """
SELECT c_custkey AS run_id, c_name AS full_name, c_nationkey AS nation,
  CASE c_custkey % 7
    WHEN 0 THEN 'User' || c_custkey || '@Example.com' WHEN 1 THEN '  user' || c_custkey || '@mail-host.org ' WHEN 2 THEN 'user.' || c_custkey || '+tag@example.io'
    WHEN 3 THEN 'user' || c_custkey || '@example.co.uk' WHEN 4 THEN 'not-an-email-' || c_custkey WHEN 5 THEN '' ELSE 'USER_' || c_custkey || '@EXAMPLE.NET' END AS email,
  CASE c_custkey % 8
    WHEN 0 THEN '(' || (200 + c_custkey % 600) || ') ' || (200 + c_custkey * 7 % 700) || '-' || lpad(cast(c_custkey % 10000 AS varchar(9)), 4, '0')
    WHEN 1 THEN (200 + c_custkey % 600) || '-' || (200 + c_custkey * 7 % 700) || '-' || lpad(cast(c_custkey % 10000 AS varchar(9)), 4, '0')
    WHEN 2 THEN (200 + c_custkey % 600) || '.' || (200 + c_custkey * 7 % 700) || '.' || lpad(cast(c_custkey % 10000 AS varchar(9)), 4, '0')
    WHEN 3 THEN '+1' || (200 + c_custkey % 600) || (200 + c_custkey * 7 % 700) || lpad(cast(c_custkey % 10000 AS varchar(9)), 4, '0')
    WHEN 4 THEN '1 ' || (200 + c_custkey % 600) || ' ' || (200 + c_custkey * 7 % 700) || ' ' || lpad(cast(c_custkey % 10000 AS varchar(9)), 4, '0')
    WHEN 5 THEN '+44 20 7946 ' || lpad(cast(c_custkey % 10000 AS varchar(9)), 4, '0')
    WHEN 6 THEN '+49 30 ' || lpad(cast(c_custkey % 10000 AS varchar(9)), 6, '1') ELSE 'not-a-phone' END AS phone
FROM customer"""

PLACES = "CASE {k} % 6 WHEN 0 THEN 'Springfield, IL, USA' WHEN 1 THEN 'London, UK' WHEN 2 THEN 'India' WHEN 3 THEN 'Mumbai' WHEN 4 THEN 'Toronto, CA' ELSE 'Somewhere, Elbonia' END"

SOURCES = f"""
SELECT c.c_custkey AS run_id, 0 AS src_seq, 'csv' AS source_type, c.c_name AS full_name, k.email AS email, k.phone AS phone,
  {PLACES.format(k="c.c_custkey")} AS location_raw, CASE WHEN c.c_custkey % 2 = 0 THEN c.c_mktsegment END AS headline, 'Python, JS, ' || lower(c.c_mktsegment) AS skills
FROM customer c JOIN ({CONTACTS}) k ON c.c_custkey = k.run_id
UNION ALL
SELECT c_custkey, 1, 'ats_json', upper(c_name), 'user' || c_custkey || '@example.com', (200 + c_custkey % 600) || (200 + c_custkey * 7 % 700) || lpad(cast(c_custkey % 10000 AS varchar(9)), 4, '0'),
  CASE WHEN c_custkey % 2 = 0 THEN {PLACES.format(k="(c_custkey + 1)")} END, CASE WHEN c_custkey % 4 = 0 THEN 'Head of ' || c_mktsegment ELSE ' ' END, 'py, Docker, sql'
FROM customer WHERE c_custkey % 3 = 0
UNION ALL
SELECT c_custkey, 2, 'recruiter_txt', c_name, 'user' || c_custkey || '@example.com', 'none', CAST(NULL AS varchar(99)), c_mktsegment, 'docker, k8s'
FROM customer WHERE c_custkey % 5 = 0
UNION ALL
SELECT s_suppkey, 3, 'github_url', s_name, CASE WHEN s_suppkey % 2 = 0 THEN 'dev' || s_suppkey || '@code.example' END, CAST(NULL AS varchar(99)),
  {PLACES.format(k="s_suppkey")}, CAST(NULL AS varchar(99)), 'Go, rust, node.js'
FROM supplier"""

#: Jobs of each customer, from their orders.
JOBS = """
SELECT o_custkey AS run_id, o_orderkey AS seq, o_orderpriority AS company, o_orderstatus AS title,
  CASE WHEN o_orderkey % 3 <> 0 THEN cast(year(o_orderdate) AS varchar(9)) || '-' || lpad(cast(month(o_orderdate) AS varchar(9)), 2, '0') END AS job_start,
  CASE WHEN o_orderkey % 2 = 0 THEN cast(year(o_orderdate) + 1 AS varchar(9)) || '-' || lpad(cast(month(o_orderdate) AS varchar(9)), 2, '0') END AS job_end
FROM orders"""

DATES = """
SELECT o_orderkey, CASE o_orderkey % 10
  WHEN 0 THEN year(o_orderdate) || '-' || lpad(cast(month(o_orderdate) AS varchar(9)), 2, '0') WHEN 1 THEN lpad(cast(month(o_orderdate) AS varchar(9)), 2, '0') || '/' || year(o_orderdate)
  WHEN 2 THEN 'March ' || year(o_orderdate) WHEN 3 THEN 'Sept ' || year(o_orderdate) WHEN 4 THEN cast(year(o_orderdate) AS varchar(9)) WHEN 5 THEN 'Present' WHEN 6 THEN '  '
  WHEN 7 THEN year(o_orderdate) || '-' || (year(o_orderdate) + 2) WHEN 8 THEN 'Mar. ' || year(o_orderdate) ELSE 'dec  ' || year(o_orderdate) || ' or so' END AS raw
FROM orders"""

PATHS = """
SELECT p_partkey AS id, CASE p_partkey % 11
  WHEN 0 THEN 'in/' || p_partkey || '.CSV' WHEN 1 THEN 'a.b/' || p_partkey || '.json' WHEN 2 THEN 'cv ' || p_partkey || '.pdf' WHEN 3 THEN 'cv.docx' WHEN 4 THEN 'old.doc'
  WHEN 5 THEN 'notes.txt' WHEN 6 THEN 'https://github.com/u' || p_partkey WHEN 7 THEN 'https://www.linkedin.com/in/u' || p_partkey WHEN 8 THEN 'dir.csv/none' WHEN 9 THEN '.csv'
  ELSE 'archive.tar.gz' END AS path FROM part
UNION ALL SELECT -1 - page_id, url FROM pages"""

SKILL_NAMES = """
SELECT p_partkey, CASE p_partkey % 9 WHEN 0 THEN p_name WHEN 1 THEN ' JS ' WHEN 2 THEN 'k8s' WHEN 3 THEN 'node.js' WHEN 4 THEN 'express.js' WHEN 5 THEN 'go-lang TOOLS' WHEN 6 THEN 'C++'
  WHEN 7 THEN p_brand ELSE '3d modelling' END AS raw FROM part"""

LOCATIONS = f"""
SELECT c_custkey AS id, {PLACES.format(k="c_custkey")} AS raw FROM customer
UNION ALL SELECT -1 - n_nationkey, n_name || ', ' || CASE n_nationkey % 4 WHEN 0 THEN 'us' WHEN 1 THEN 'Great Britain' WHEN 2 THEN 'Brazil' ELSE n_name END FROM nation"""

#: Texts that say skills and handles: documents with a synthetic end.
SKILL_TEXTS = """
SELECT doc_id, text || CASE doc_id % 6 WHEN 0 THEN ' Knows Node.js, Spring Boot and REST API design.' WHEN 1 THEN ' python/sql; machine learning (k8s)' WHEN 2 THEN ' C++ c# HTML/CSS'
  WHEN 3 THEN ' gopher golang goes' WHEN 4 THEN ' See linkedin.com/in/some-one' || doc_id || ' GitHub.com/orgs github.com/dev' || doc_id || '/x www.site.example/p. ' ELSE '' END AS text FROM documents"""

#: Resumes of customers, of eight kinds that together meet every rule of the section parsers.
RESUMES = """
SELECT c_custkey AS run_id, CASE c_custkey % 4 WHEN 0 THEN c_name WHEN 1 THEN 'Jo Doe' || c_custkey WHEN 2 THEN '  Résumé
Ána Li Wu' ELSE 'JO DOE SKILLS' END || '
Jo' || c_custkey || '@Mail.example | +1 (415) 555-' || lpad(cast(c_custkey % 10000 AS varchar(9)), 4, '0')
  || CASE c_custkey % 5 WHEN 0 THEN ' linkedin.com/in/jo-' || c_custkey WHEN 1 THEN ' github.com/orgs github.com/jo' || c_custkey || ' https://jo' || c_custkey || '.example/me' WHEN 2 THEN ' London, uk 020 7946 0' || lpad(cast(c_custkey % 1000 AS varchar(9)), 3, '0') ELSE '' END || '
' || CASE c_custkey % 8
  WHEN 0 THEN 'Work Experience
Engineer at Acme ' || c_custkey || '
Jan 201' || (c_custkey % 10) || ' - ' || CASE WHEN c_custkey % 3 = 0 THEN 'Present' ELSE 'Mar 2020' END || '
• Did things
* More things

Lead | Initech
2012 to 2015
Education
State University, Springfield
Bachelor of Science, Physics, 2008 - 2012
Skills
Python'
  WHEN 1 THEN 'EMPLOYMENT
Engineer - January 2015 – Mar. 2018
Acme ' || c_custkey || '
built pipelines with kafka
Senior Engineer | 2018 - Present
Acme Two, Ltd
- led a team
Academic record

Tech College

M.Sc, Maths, class of 201' || (c_custkey % 10) || '
Other Institute
visited in 1999 and 2001'
  WHEN 2 THEN 'Career
Analyst, Globex ' || c_custkey || ', Inc
2012 - 201' || (3 + c_custkey % 6) || '
wrote reports
used many tools
lost since the section is closed
Education
Open School'
  WHEN 3 THEN 'Experience
Great Company
Umbrella ' || c_custkey || '
Sept 2016 - current
2019 to 2016
Tester
Nowhere at All'
  WHEN 4 THEN 'Worked 2010 - 2012 somewhere
MBA, Business, 2010'
  WHEN 5 THEN 'Education
First University, Rome
PhD
Skills
sql and rust
Education
Second School
Associate degree, Law
Employment history
Clerk | Office ' || c_custkey || '
  May 2001—Jun 2003
filed papers
  and more papers  '
  WHEN 6 THEN 'Work history
Intern at Lab ' || c_custkey || '

Manager at Plant ' || c_custkey || '

2001 - 2002

Education'
  ELSE 'Professional experience and a heading that is far too long to count as one of a section
Experience
2015 - 2017 Driver ' || c_custkey || '
Cargo
-
drove
Technical' END AS content FROM customer"""

#: Items of each customer as text; some can't be read, some are of no known type. Joined with ITEM_RECORDS, what is in them.
ITEMS = f"""
SELECT run_id, 0 AS src_seq, 'csv' AS source_type, CASE WHEN run_id % 23 = 5 THEN NULL ELSE 'full_name,EMAIL,phone,Location,headline,skills
' || full_name || ',' || email || ',' || phone || ',"' || {PLACES.format(k="run_id")} || '",' || CASE WHEN run_id % 2 = 0 THEN c_mktsegment ELSE ' ' END || ',"Python, JS, ' || lower(c_mktsegment) || '"' END AS content
FROM ({CONTACTS}) k JOIN customer c ON c.c_custkey = k.run_id
UNION ALL
SELECT c_custkey, 1, 'ats_json', '{{"candidateName":"' || upper(c_name) || '","email":["user' || c_custkey || '@example.com"],"mobile":"' || (200 + c_custkey % 600) || (200 + c_custkey * 7 % 700) || lpad(cast(c_custkey % 10000 AS varchar(9)), 4, '0')
  || '","skillSet":["py",{{"name":"Docker"}},"sql"]' || CASE WHEN c_custkey % 2 = 0 THEN ',"city":"' || {PLACES.format(k="(c_custkey + 1)")} || '"' ELSE '' END || CASE WHEN c_custkey % 4 = 0 THEN ',"currentTitle":"Head of ' || c_mktsegment || '"' ELSE '' END || '}}'
FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 23 <> 5
UNION ALL
SELECT c_custkey, 2, 'recruiter_txt', 'Candidate notes
reach USER' || c_custkey || '@example.com, knows docker and kubernetes' FROM customer WHERE c_custkey % 5 = 0 AND c_custkey % 23 <> 5
UNION ALL
SELECT c_custkey, 3, 'resume_docx', CAST(NULL AS varchar(9)) FROM customer WHERE c_custkey % 17 = 3
UNION ALL
SELECT c_custkey, 4, CAST(NULL AS varchar(9)), 'archive.tar.gz' FROM customer WHERE c_custkey % 19 = 1"""

ITEM_RECORDS = f"""
SELECT run_id, 0 AS src_seq, 'csv' AS source_type, full_name, nullif(trim(email), '') AS email, phone, {PLACES.format(k="run_id")} AS location_raw, CASE WHEN run_id % 2 = 0 THEN c_mktsegment END AS headline, 'Python, JS, ' || lower(c_mktsegment) AS skills
FROM ({CONTACTS}) k JOIN customer c ON c.c_custkey = k.run_id WHERE run_id % 23 <> 5
UNION ALL
SELECT c_custkey, 1, 'ats_json', upper(c_name), 'user' || c_custkey || '@example.com', (200 + c_custkey % 600) || (200 + c_custkey * 7 % 700) || lpad(cast(c_custkey % 10000 AS varchar(9)), 4, '0'),
  CASE WHEN c_custkey % 2 = 0 THEN {PLACES.format(k="(c_custkey + 1)")} END, CASE WHEN c_custkey % 4 = 0 THEN 'Head of ' || c_mktsegment END, 'py, Docker, sql'
FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 23 <> 5
UNION ALL
SELECT c_custkey, 2, 'recruiter_txt', NULL, 'user' || c_custkey || '@example.com', NULL, NULL, NULL, 'Docker, Kubernetes'
FROM customer WHERE c_custkey % 5 = 0 AND c_custkey % 23 <> 5"""


#: Tasks that each core gets of a dealt table, and the bytes (by Spark's estimate) that one of them holds at most.
TASKS_A_CORE, TASK_BYTES = 4, 64 << 20


def dealt(table: DataFrame) -> DataFrame:
    """The rows of a table over all cores, by its first column, which is its key. A file with one row group is one task, however many splits it has."""
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return table.repartition(max(TASKS_A_CORE * table.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_BYTES)), table.columns[0])


def view(spark: SparkSession, sf_dir: str, sql: str, deal: bool = False) -> DataFrame:
    """The rows of ``sql`` over the driver's tables; ``deal`` where the work on each row is much and begins at once, without an exchange."""
    for t in TABLES:
        if t in sql:
            table = spark.read.parquet(f"{sf_dir}/{t}.parquet")
            (dealt(table) if deal else table).createOrReplaceTempView(t)
    return spark.sql(sql)


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw records of :data:`SOURCES`."""
    rows = view(spark, sf_dir, SOURCES)
    one = lambda c: F.when(F.col(c).isNotNull(), F.array(c))
    return raw_records(rows, full_name=F.col("full_name"), emails=one("email"), phones=one("phone"), location_raw=F.col("location_raw"), headline=F.col("headline"), skills_raw=comma_list(F.col("skills")))


def job_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raw record for each customer with all of their jobs."""
    rows = view(spark, sf_dir, JOBS)
    job = F.struct("seq", "company", "title", F.col("job_start").alias("start"), F.col("job_end").alias("end"), F.lit(None).cast("string").alias("summary"))
    each = rows.groupBy("run_id").agg(F.sort_array(F.collect_list(job)).alias("jobs"))
    each = each.withColumn("src_seq", F.lit(0)).withColumn("source_type", F.lit("csv"))
    return raw_records(each, experience=F.transform("jobs", lambda j: j.dropFields("seq")))


def course_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, JOBS)
    course = F.struct("seq", F.col("company").alias("institution"), F.col("title").alias("degree"), F.col("job_start").alias("field"), F.substring("job_end", 1, 4).cast("int").alias("end_year"))
    each = rows.groupBy("run_id").agg(F.sort_array(F.collect_list(course)).alias("courses")).withColumn("src_seq", F.lit(0)).withColumn("source_type", F.lit("csv"))
    return raw_records(each, education=F.transform("courses", lambda c: c.dropFields("seq")))
