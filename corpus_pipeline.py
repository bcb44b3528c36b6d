"""Curate a corpus in five stages, each written as Parquet and read again as the next one's documents.

Every stage works on all rows that its predecessor kept and, but for the last, returns the columns of documents. Null and
empty texts pass as the operators define: they hold nothing toxic, are judged by the quality trees like any other text, are
one group of fingerprint zero of which one row stays, and mix and encode as empty. Very long texts are read whole. Rows that
repeat a doc_id or have none are judged by their own texts; of equal or near texts one row stays. Further columns of
documents, whatever their names, go along to the last stage. Ties are decided as each operator states; none depends on the
order of rows. An empty table gives no row. Without labels nothing is toxic, and every text is good enough.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from amalgam.llm import bpe, mixing, quality, simhash, toxicity
from amalgam.llm.common import dropped, saved, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal regression doesn't reject."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the boosted trees predict to be good."""
    return quality.good(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked fingerprints, that with the smallest doc_id."""
    return simhash.kept_rows(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn and repeated by raked weights."""
    return mixing.mixed(docs, repeats=True)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's number of tokens and digests of its ids and its decoded text."""
    return bpe.digests(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality classifier", keep_good),
    ("SimHash near-dedup", drop_near_copies),
    ("source mixing", mix_sources),
    ("BPE encoding and decoding", encode),
]

#: Trained models and a hash that DuckDB lacks decide what stays, so SQL can't express the rows; tests do by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        dropped(before)  # the documents that a stage has read
    return STAGES[-1][1](spark, docs, sf_dir)
