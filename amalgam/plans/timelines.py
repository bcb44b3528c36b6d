"""Queries over times: sessions, versions as of a time, overlapping intervals, rolling figures and coverage, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from amalgam.operators import timeline
from amalgam.plans import inputs as I
from amalgam.plans.queries import query

#: The kinds of submissions in events, and the gap in hours that ends a session.
KINDS, GAP_HOURS = ["click", "error", "purchase", "signup", "view"], 6

_LAST = ", ".join(f"arg_max(value, (ts, event_id)) FILTER (WHERE event_type = '{k}' AND value IS NOT NULL) AS {k}" for k in KINDS)


@query(f"""WITH step AS (SELECT *, CASE WHEN ts <= lag(ts) OVER w + INTERVAL {GAP_HOURS} HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    island AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM step)
  SELECT user_id, min(ts) AS started, max(ts) AS ended, count(*) AS n, {_LAST} FROM island GROUP BY user_id, island""")
def submission_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Submissions of a user within six hours of each other, with the last value of each kind."""
    return timeline.sessions(I.view(spark, sf_dir, "SELECT * FROM events"), "user_id", "ts", f"{GAP_HOURS} hours", "event_type", KINDS, "event_id", "value")


#: Views look up what the latest other event of their user said.
LOOKUPS = "SELECT user_id, ts, event_id FROM events WHERE event_type = 'view'"
VERSIONS = "SELECT user_id, ts, event_id AS version_id, event_type, value FROM events WHERE event_type <> 'view'"


@query(f"""WITH l AS ({LOOKUPS}), v AS ({VERSIONS})
  SELECT l.event_id, l.user_id, v.version_id, v.event_type AS kind, v.value FROM l ASOF LEFT JOIN v ON l.user_id = v.user_id AND l.ts >= v.ts""")
def profile_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored version of each user as of each of their views."""
    found = timeline.as_of(I.view(spark, sf_dir, LOOKUPS), I.view(spark, sf_dir, VERSIONS), "user_id", "ts", "version_id")
    return found.select("event_id", "user_id", F.col("version.version_id").alias("version_id"), F.col("version.event_type").alias("kind"), F.col("version.value").alias("value"))


@query(f"""WITH v AS ({VERSIONS}) SELECT user_id, version_id, ts AS valid_from, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, version_id) AS valid_to FROM v""")
def version_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validity of every stored version of a user."""
    return timeline.validity(I.view(spark, sf_dir, VERSIONS), "user_id", "ts", "version_id").select("user_id", "version_id", F.col("ts").alias("valid_from"), "valid_to")


#: A job of one to 24 months from each order; twenty orders in a row name one company. Months are counted from the year 0.
TENURES = """SELECT o_orderkey AS job, o_custkey AS person, cast(floor(o_orderkey / 20) AS bigint) AS company, cast(year(o_orderdate) * 12 + month(o_orderdate) AS bigint) AS first_month,
  cast(year(o_orderdate) * 12 + month(o_orderdate) + o_orderkey % 24 AS bigint) AS last_month FROM orders"""


@query(f"""WITH job AS ({TENURES}), months AS (SELECT DISTINCT person, unnest(range(first_month, last_month + 1)) AS month FROM job),
    plain AS (SELECT person, sum(last_month - first_month + 1) AS months_counted_twice, count(*) AS jobs FROM job GROUP BY person)
  SELECT person, CAST(count(*) AS BIGINT) AS months, CAST(any_value(months_counted_twice) AS BIGINT) AS months_counted_twice, any_value(jobs) AS jobs FROM months JOIN plain USING (person) GROUP BY person""")
def tenure_without_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months in which a person had a job, beside their jobs' months added up."""
    jobs = I.view(spark, sf_dir, TENURES)
    merged = timeline.merged_intervals(jobs.withColumn("months", F.col("last_month") - F.col("first_month") + 1), "person", "first_month", "last_month")
    union = merged.groupBy("person").agg(F.sum(F.col("last_month") - F.col("first_month") + 1).alias("months"), F.sum("n").alias("jobs"))
    plain = jobs.groupBy("person").agg(F.sum(F.col("last_month") - F.col("first_month") + 1).alias("months_counted_twice"))
    return union.join(plain, "person").select("person", "months", "months_counted_twice", "jobs")


@query(f"""WITH job AS ({TENURES}) SELECT a.company, a.job AS job, b.job AS other, least(a.last_month, b.last_month) - greatest(a.first_month, b.first_month) + 1 AS months
  FROM job a JOIN job b ON a.company = b.company AND a.job < b.job AND a.first_month <= b.last_month AND b.first_month <= a.last_month""")
def colleagues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs at one company whose months overlap."""
    jobs = I.view(spark, sf_dir, TENURES)
    met = timeline.overlapping(jobs, jobs, "company", "first_month", "last_month", 12).filter("a.job < b.job")
    return met.select("a.company", F.col("a.job").alias("job"), F.col("b.job").alias("other"), (F.least("a.last_month", "b.last_month") - F.greatest("a.first_month", "b.first_month") + 1).alias("months"))


#: Conflicting submissions of each source and day: those whose value differs from the kind's usual one; days are numbered.
DRIFT = """SELECT event_type AS source, cast(datediff(cast(ts AS date), date '2024-01-01') AS bigint) AS day, sum(CASE WHEN value > 100 THEN 1 END) AS conflicts FROM events GROUP BY 1, 2"""


@query(f"""WITH daily AS ({DRIFT.replace("datediff(cast(ts AS date), date '2024-01-01')", "cast(ts AS date) - date '2024-01-01'")})
  SELECT source, day, CAST(conflicts AS BIGINT) AS conflicts, CAST(sum(conflicts) OVER span AS BIGINT) AS rolling, count(conflicts) OVER span AS days_known,
    CAST(last_value(conflicts IGNORE NULLS) OVER (PARTITION BY source ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT) AS before,
    rank() OVER (PARTITION BY day ORDER BY conflicts DESC NULLS LAST) AS rank, dense_rank() OVER (PARTITION BY day ORDER BY conflicts DESC NULLS LAST) AS dense_rank
  FROM daily WINDOW span AS (PARTITION BY source ORDER BY day RANGE BETWEEN 29 PRECEDING AND CURRENT ROW)""")
def conflict_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rolling conflicts of thirty days for each source."""
    return timeline.rolling(I.view(spark, sf_dir, DRIFT), "source", "day", "conflicts", 30)


#: What each source says of each customer: where they are and how well they are known.
COVERAGE = """SELECT o_custkey AS candidate, o_orderpriority AS source, n_name AS country, CASE WHEN c_acctbal > 6000 THEN 'high' WHEN c_acctbal > 2000 THEN 'medium' ELSE 'low' END AS badge
  FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey"""


@query(f"""SELECT source, country, badge, CAST(grouping(source, country, badge) AS BIGINT) AS grouping, count(*) AS n, count(DISTINCT candidate) AS keys FROM ({COVERAGE}) GROUP BY CUBE (source, country, badge)""")
def coverage_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Submissions and candidates by source, country and badge with all totals."""
    return timeline.coverage(I.view(spark, sf_dir, COVERAGE), ["source", "country", "badge"], "candidate")
