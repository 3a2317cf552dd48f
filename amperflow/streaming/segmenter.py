"""Segments of streams across micro-batches: state per series, by run, by rows and by wall clock.

The clock is the micro-batch's own time, which Spark's log keeps: a batch that is repeated is cut alike.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructType


class Segmenter(StatefulProcessor):
    """State of a series: its run, segment, rows in it, and the time of the batch with which it began.

    Age is looked at only where a chunk of one run begins within a batch; a chunk under way is not
    cut by time. Row limits cut exactly.
    """

    def __init__(self, columns: list[str], rows: int | None, seconds: float | None):
        self.columns, self.rows, self.seconds = columns, rows, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("segment", "run string, segment long, rows long, began double")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803 -- Spark's names
        run, segment, count, began = self.state.get() if self.state.exists() else (None, 0, 0, 0.0)
        made = Row(*self.columns, "segment")
        first, before = True, None
        # One micro-batch of one series: sorted by arrival, as its rows come in any order.
        for row in sorted(rows, key=lambda r: (r["_seq"] is None, r["_seq"])):
            now, chunk = row["__now"], first or row["run_id"] != before
            first, before = False, row["run_id"]
            due = chunk and self.seconds is not None and count and now - began >= self.seconds
            if segment == 0 or row["run_id"] != run or due or (self.rows and count >= self.rows):
                run, segment, count, began = row["run_id"], segment + 1, 0, now
            count += 1
            yield made(*(row[c] for c in self.columns), segment)
        self.state.update((run, segment, count, began))

    def close(self) -> None:
        pass


def segmented_stream(df: DataFrame, rows: int | None = None, seconds: float | None = None) -> DataFrame:
    """A stream with series_id, run_id, _seq and any other columns, with ``segment``. Needs the RocksDB state store."""
    out = StructType([*df.schema.fields]).add("segment", LongType())
    timed = df.withColumn("__now", F.current_timestamp().cast("double"))
    return timed.groupBy("series_id").transformWithState(statefulProcessor=Segmenter(df.columns, rows, seconds), outputStructType=out, outputMode="Append", timeMode="None")
