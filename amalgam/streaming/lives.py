"""Keyed state: a candidate's submissions that follow each other within a gap are one life of their profile.

Each candidate's open lives are held in the state of one key: begin, end, number of submissions and the last value of each field
(by time, then by id). A late submission is added to the life that it falls into, and may join two. When the watermark passes a
life's end by the gap, its timer fires: the life is given out and its state dropped, so the state holds open lives only. The
result is that of ``timeline.sessions`` over all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATE = "started long, ended long, n long, ats array<long>, ties array<long>, vals array<double>"


class Lives(StatefulProcessor):
    """Rows (key, at in microseconds, tie, field number, value) to closed lives. ``fields``: how many there are."""

    def __init__(self, gap: int, fields: int):
        self.gap, self.fields = gap, fields

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "started long", STATE)

    def _add(self, lives: list[tuple], at: int, tie: int, field: int, value: float) -> list[tuple]:
        # a submission without a value, or of no field that is kept, only counts
        own = (at, at, 1, *([x if i == field and value is not None else None for i in range(self.fields)] for x in (at, tie, value)))
        apart = []
        for life in lives:
            near = own[0] <= life[1] + self.gap and life[0] <= own[1] + self.gap
            if near:
                own = self._joined(own, life)
            else:
                apart.append(life)
        return [*apart, own]

    @staticmethod
    def _joined(a: tuple, b: tuple) -> tuple:
        later = [y if x[0] is None or (y[0] is not None and y[:2] > x[:2]) else x for x, y in zip(zip(*a[3:], strict=True), zip(*b[3:], strict=True), strict=True)]
        return (min(a[0], b[0]), max(a[1], b[1]), a[2] + b[2], *(list(c) for c in zip(*later, strict=True)))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = {k[0]: tuple(v) for k, v in self.open.iterator()}
        lives = list(before.values())
        for batch in rows:
            for at, tie, field, value in zip(batch["at"].tolist(), batch["tie"].tolist(), batch["field"].tolist(), batch["value"].tolist(), strict=True):
                lives = self._add(lives, at, tie, field, None if pd.isna(value) else value)
        after = {life[0]: life for life in lives}
        for started, life in before.items():
            if after.get(started) != life:
                self.handle.deleteTimer(self._due(life))
                self.open.removeKey((started,))
        for started, life in after.items():
            if before.get(started) != life:
                self.open.updateValue((started,), life)
                self.handle.registerTimer(self._due(life))
        return iter(())

    def _due(self, life: tuple) -> int:
        """Milliseconds from which nothing can be added; rounded up."""
        return -(-(life[1] + self.gap) // 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        closed = [tuple(v) for _, v in self.open.iterator() if self._due(tuple(v)) <= now]
        for life in closed:
            self.open.removeKey((life[0],))
        if closed:
            rows = [(key[0], s, e, n, list(vals)) for s, e, n, _, _, vals in closed]
            yield pd.DataFrame(rows, columns=["key", "started", "ended", "n", "vals"])

    def close(self) -> None:
        pass


def lives(stream: DataFrame, key: str, at: str, gap_seconds: int, late: str, fields: str, names: list[str], tie: str, value: str) -> DataFrame:
    """A stream of closed lives (key, started, ended, n, the last value of each field) from a stream of submissions.

    A submission that comes again within ``late`` is dropped, one that is later than that too. Without a key or time it is no one's. Needs
    the state store that keeps its rows on disk (RocksDB).
    """
    number = F.coalesce(F.array_position(F.array(*map(F.lit, names)), F.col(fields)), F.lit(0)) - 1
    rows = stream.filter(F.col(key).isNotNull() & F.col(at).isNotNull()).withWatermark(at, late).dropDuplicatesWithinWatermark([key, tie])
    rows = rows.select(F.col(key).cast("long").alias("key"), F.unix_micros(at).alias("at"), F.col(tie).cast("long").alias("tie"), number.cast("int").alias("field"), F.col(value).cast("double").alias("value"))
    closed = rows.groupBy("key").transformWithStateInPandas(Lives(gap_seconds * 1_000_000, len(names)), "key long, started long, ended long, n long, vals array<double>", "Append", "EventTime")
    return closed.select(F.col("key").alias(key), F.timestamp_micros("started").alias("started"), F.timestamp_micros("ended").alias("ended"), "n", *(F.get("vals", F.lit(i)).alias(f) for i, f in enumerate(names)))
