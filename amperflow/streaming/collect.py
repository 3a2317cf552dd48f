"""Collecting and importing: samples from a source to a sink, in batches, under an error policy."""

from __future__ import annotations

import logging
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..operators import gate, project
from ..operators.ledger import Ledger, candidates
from ..sinks.feed import write_feed
from ..sources.catalog import flight_lines, readable
from .supervisor import ErrorPolicy, Guard

log = logging.getLogger(__name__)


@dataclass
class Stats:
    samples: int = 0
    polls: int = 0
    batches: int = 0
    errors: int = 0
    duration_s: float = 0.0


#: Why a flight log cannot be imported. Fixed values of this engine's ledger.
REASONS = {"text": "not UTF-8 text", "head": "no header with a time and a voltage", "time": "no row with a time", "row": "no plausible row"}


def import_flights(spark: SparkSession, folder: str, out: str, ledger_dir: str, institution: str = "LOCAL", include_gps: bool = False) -> dict[str, int]:
    """All new flight logs of a folder in one go: gate, feed files, and only then the ledger.

    Files without a usable row are set aside, each with its own reason; none stops the others. A crash
    before the ledger is written imports the same files again, into new feed files.
    """
    ledger = Ledger(spark, ledger_dir)
    new = ledger.new(candidates(spark, folder, ledger)).dropDuplicates(["content_hash"]).withColumn("csv", readable("content")).drop("content")
    new = new.cache()
    try:
        seen = new.agg(F.count("content_hash").alias("files"), F.count_if(F.col("content_hash").isNull()).alias("empty")).first()
        if not seen.files and not seen.empty:
            return {"files": 0, "samples": 0, "quarantined": 0}
        logs = new.where("content_hash is not null")
        samples, summaries, _ = gate.normalize_flights(flight_lines(logs.where("csv is not null")), include_gps)
        summaries = summaries.select("content_hash", "rows_total", "records", "bad_ts").cache()
        good = summaries.where("records > 0").select("content_hash")
        samples = project.flat_cells(samples).cache()
        n = samples.count()
        if n:
            write_feed(samples, out, institution)
        ledger.record(logs.join(good, "content_hash", "left_semi"))
        head = F.substring_index(F.col("csv"), "\n", 1)
        why = (
            F.when(F.col("csv").isNull(), REASONS["text"]).when(~head.contains("CUSTOM.dateTime") | ~head.contains("BATTERY.voltage"), REASONS["head"])
            .when(F.coalesce(F.col("rows_total") == F.col("bad_ts"), F.lit(True)), REASONS["time"]).otherwise(REASONS["row"])
        )
        bad = logs.join(good, "content_hash", "left_anti").join(summaries, "content_hash", "left").withColumn("reason", why)
        aside = ledger.quarantine(bad)
        samples.unpersist()
        summaries.unpersist()
        if seen.empty:
            log.warning("empty files are skipped and looked at again next time")
        return {"files": seen.files, "samples": n, "quarantined": aside}
    finally:
        new.unpersist()


class Counts(StreamingQueryListener):
    """What a stream's observed rows add up to over all its queries and restarts, however many batches there were."""

    def __init__(self) -> None:
        self.name = f"samples-{uuid.uuid4().hex}"
        self.rows = self.untimed = self.batches = 0
        self.last: dict[str, int] = {}

    def observed(self, df: DataFrame) -> DataFrame:
        """``df``, its rows and those without a time of their own counted on their way, not in a pass of their own."""
        untimed = F.col("test_time_second").isNull() if "test_time_second" in df.columns else F.lit(True)
        return df.observe(self.name, F.count(F.lit(1)).alias("rows"), F.count_if(untimed).alias("untimed"))

    def onQueryStarted(self, event) -> None:  # noqa: N802 -- Spark's names
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        found = event.progress.observedMetrics.get(self.name)
        if found is not None:
            self.rows += found.rows
            self.untimed += found.untimed
            self.batches += found.rows > 0
            self.last[str(event.progress.runId)] = event.progress.batchId

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass

    def caught_up(self, query, most: float = 10.0) -> None:
        """Wait until the last progress of a query that has ended was counted: events come by themselves."""
        until, last = time.monotonic() + most, query.lastProgress
        while last and self.last.get(str(last["runId"]), -1) < last["batchId"] and time.monotonic() < until:
            time.sleep(0.02)


def collect_stream(df: DataFrame, start: Callable[[DataFrame, bool], Any], duration: float | None = None, policy: ErrorPolicy | None = ErrorPolicy(), clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep, stop: Callable[[], bool] = lambda: False) -> Stats:
    """Run the query that ``start`` gives of the counted stream until ``duration`` is over or ``stop`` says so.

    What has arrived by then is written before it ends, by one more query that takes what there is
    (the second argument of ``start``). A query that fails is started again from its checkpoint, under
    the policy; one that got on before it failed begins a new count of failures.
    """
    guard, began, counts = Guard(policy, sleep), clock(), Counts()
    over = lambda: stop() or (duration is not None and clock() >= began + duration)
    spark = df.sparkSession
    spark.streams.addListener(counts)
    polls, last = 0, False
    try:
        while not last:
            last, query, before = over(), None, counts.rows
            polls += 1
            try:
                query = start(counts.observed(df), last)
                while query.isActive and (last or not over()):
                    query.awaitTermination(0.2)
                query.stop()
                counts.caught_up(query)
                if query.exception() is not None:
                    raise query.exception()
            except Exception as e:  # noqa: BLE001 -- whatever ended the query
                if query is not None:
                    counts.caught_up(query)
                if counts.rows > before:
                    guard.succeeded()
                guard.failed(e)
                last = False
    finally:
        spark.streams.removeListener(counts)
    if counts.untimed and "series_id" in df.columns:
        log.warning("%d routed samples have no time of their own; their source should give one", counts.untimed)
    return Stats(samples=counts.rows, polls=polls, batches=counts.batches, errors=guard.errors, duration_s=clock() - began)


def stream_to(df: DataFrame, write: Callable[[DataFrame, int], Any], checkpoint: str, once: bool = True, interval: str = "1 second"):
    """Micro-batches to ``write(batch, id)``; offsets are committed after it returned."""
    out = df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out.trigger(processingTime=interval)).start()
