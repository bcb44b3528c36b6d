"""Every query with SQL against DuckDB, at the smallest scale."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from amalgam.plans.inputs import TABLES

QUERIES, SQL = __spark_entry__.queries(), __spark_entry__.oracle_sql()


def table(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(columns), sorted(repr([r[i] for i in order]) for r in rows)


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf_dir, duck, name):
    df, rel = QUERIES[name](spark, sf_dir), duck.sql(SQL[name])
    assert table(df.columns, map(tuple, df.collect())) == table(rel.columns, rel.fetchall())


@pytest.mark.parametrize("name", sorted(q for q in QUERIES.keys() - SQL.keys() if not q.startswith("op") and q != "pipeline"))
def test_query_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["csv_scan", "ats_scan", "phone_e164", "experience_parse", "education_parse", "resume_years"])
def test_rows_of_one_file_are_dealt_out(spark, sf_dir, name):
    """Each table is one file with one row group, so one task's work if it is read and parsed in one stage."""
    parts = QUERIES[name](spark, sf_dir).select(F.spark_partition_id().alias("p")).distinct().count()
    assert parts >= 8
