"""Submissions as a stream: landed files are read, consolidated batch by batch and folded into the store.

An extension: readers, merge and scores are those of the batch plan, as all of them are columns and DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from amalgam.operators.scratch import deleted, scratch_path
from amalgam.operators.store import CandidateStore
from amalgam.plans.consolidate import extract, landed_by_type, profiles_of
from amalgam.sources.detect import admitted

ITEMS = "run_id string, src_seq int, source_type string, content string, submitted_at timestamp"


def landed_items(spark: SparkSession, path: str, late: str = "1 day", files_each: int = 1000) -> DataFrame:
    """A stream of source items from landed JSON lines; an item delivered again within ``late`` is dropped."""
    stream = spark.readStream.schema(ITEMS).option("maxFilesPerTrigger", files_each).json(path)
    return stream.withWatermark("submitted_at", late).dropDuplicatesWithinWatermark(["run_id", "src_seq", "source_type", "content"])


def fold_into(store: CandidateStore, items: DataFrame, as_of: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Start folding a stream of items into the store. A batch that is delivered again, with the same checkpoint, changes nothing."""

    def save(batch: DataFrame, number: int) -> None:
        # landed by type once: the readers, and the time of the last item, read what was landed
        path = scratch_path(batch.sparkSession, "micro-batch")
        items = landed_by_type(batch, path)
        at = items.agg(F.max("submitted_at").cast("string")).first()[0]
        if at is not None:
            usable, _ = admitted(items)
            store.save(profiles_of(extract(usable, as_of), as_of), at, as_of, batch=(checkpoint, number))
        deleted(batch.sparkSession, path)

    return items.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
