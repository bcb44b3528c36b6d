"""Sharding by jump consistent hashing, in DataFrame functions only.

A row's shard follows from xxhash64(doc_id) and the number of shards; one more shard takes rows only into itself. Rows
without doc_id share one shard. Slots number a shard's rows from 0 without gaps in ascending order of (part, doc_id, text
checksum, size), where a part is one of ``PARTS`` hash parts of the shard by these three: parts are counted first, so that
no task sorts a whole shard, nor all rows without doc_id. Rows that agree in all three (repeated rows) are interchangeable:
each input partition counts them, slots are dealt to the counts, and they become rows again after those have been dealt out
anew, so no task holds more of them than a partition of the input does. Null texts have size 8 and checksum 0; very long texts
are only measured; further columns, whatever their names, are not read; an empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from amalgam.llm.common import saved, table

SHARDS, PARTS, ROW_BYTES = 24, 512, 8
#: Fixed values of the published algorithm: its 64-bit linear congruential step.
MULTIPLIER, WRAP = "2862933555777941757BD", "18446744073709551616BD"


def with_jump(rows: DataFrame, key: Column, shards: int) -> DataFrame:
    """Add ``shard`` (among ``shards``) and ``grown_shard`` (among one more) for a 64-bit key.

    Jumps only go up, so ``shards`` + 1 steps always end them; most rows do a handful and pass the rest through.
    """
    stepped = f"pmod(a.k * {MULTIPLIER} + 1BD, {WRAP})"
    end = f"""aggregate(
        sequence(1, {shards + 1}),
        named_struct('k', cast(if(_key < 0, _key + {WRAP}, cast(_key as decimal(21, 0))) as decimal(21, 0)), 'j', 0L, 's', 0L, 'g', 0L),
        (a, i) -> if(a.j > {shards}, a, named_struct(
            'k', cast({stepped} as decimal(21, 0)),
            'j', cast(floor((a.j + 1) * (2147483648D / cast(({stepped} div 8589934592BD) + 1 as double))) as bigint),
            's', if(a.j < {shards}, a.j, a.s),
            'g', a.j)),
        a -> named_struct('shard', cast(a.s as int), 'grown_shard', cast(a.g as int)))"""
    return rows.withColumn("_key", key).withColumn("_end", F.expr(end)).select("*", "_end.*").drop("_key", "_end")


def placed(docs: DataFrame, shards: int = SHARDS, parts: int = PARTS) -> DataFrame:
    """Per row: doc_id, size, text_crc32, law, shard, slot and grown_shard."""
    text = F.coalesce("text", F.lit(""))
    row = ["doc_id", "text_crc32", "size"]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.crc32(text).alias("text_crc32"), (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.spark_partition_id().alias("home"))
    each = with_jump(rows.groupBy(*row, "home").agg(F.count("*").alias("n")), F.xxhash64("doc_id"), shards)
    each = saved(each.withColumn("part", F.expr(f"cast(pmod(xxhash64(doc_id, text_crc32, size), {parts}) as int)")), "sharded")
    counts = each.groupBy("shard", "part").agg(F.sum("n").alias("all"))
    # a row for each shard and part at most, so its window and its broadcast are bounded
    before = counts.select("shard", "part", (F.sum("all").over(Window.partitionBy("shard").orderBy("part")) - F.col("all")).alias("before"))
    inside = Window.partitionBy("shard", "part").orderBy(*row, "home").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = each.withColumn("upto", F.sum("n").over(inside)).join(F.broadcast(before), ["shard", "part"])
    slots = F.sequence(F.col("before") + F.col("upto") - F.col("n"), F.col("before") + F.col("upto") - 1)
    alone = first.filter("n = 1").withColumn("slot", F.col("before") + F.col("upto") - 1)
    repeated = first.filter("n > 1").repartition(*row, "home").withColumn("slot", F.explode(slots))
    return alone.unionByName(repeated).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placed(table(spark, sf_dir, "documents"))
