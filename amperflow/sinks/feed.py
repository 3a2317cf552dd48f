"""Feed files: one CSV per (series, run, segment) with a JSON sidecar, as a Python data source writer.

Executors write each segment under a hidden name; only the commit on the driver claims final names,
so that a lost task leaves nothing behind, and no file is ever overwritten.
"""

from __future__ import annotations

import contextlib
import csv
import glob
import json
import math
import os
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from .. import schema as names
from ..functions.redact import redact_metadata
from ..operators import segment
from .feed_stream import FeedStreamWriter

INNER = ("segment", "_cell", "_info")
DESCRIBE_EVERY = 60.0


def cell_text(value) -> str:
    """A CSV cell: empty for null; numbers as Python writes them."""
    return "" if value is None else repr(value) if isinstance(value, float) and math.isfinite(value) else str(value)


@dataclass
class Written(WriterCommitMessage):
    files: list


class FeedSource(DataSource):
    """``format("feed")``: options path, institution, metadata (JSON), day (YYYYMMDD)."""

    @classmethod
    def name(cls) -> str:
        return "feed"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return FeedWriter(schema, dict(self.options))

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamWriter:  # noqa: N802 -- Spark's name
        return FeedStreamWriter(schema, dict(self.options))


class FeedWriter(DataSourceWriter):
    """Rows come grouped by ``_cell`` and ``segment`` and in order; see :func:`write_feed`.

    A file under way has a hidden name with the job in it, and beside it a description that is not
    final and that is written again every minute. The commit gives final names, and takes away what
    failed or repeated attempts of the job have left.
    """

    def __init__(self, schema: StructType, options: dict):
        self.columns = [f.name for f in schema.fields]
        self.out = [c for c in self.columns if c not in (*names.RESERVED, *names.ARRIVAL, *INNER)]
        self.options, self.job = options, uuid.uuid4().hex

    def write(self, rows: Iterator) -> Written:
        folder, made, at, file = self.options["path"], [], None, None
        os.makedirs(folder, exist_ok=True)
        for row in rows:
            key = (row["_cell"], row["segment"])
            if key != at:
                if file:
                    file.close()
                at = key
                part = os.path.join(folder, f".{self.job}-{uuid.uuid4().hex}.part")
                file = open(part, "w", newline="", encoding="utf-8")  # noqa: SIM115
                out = csv.writer(file, lineterminator="\n")
                out.writerow(self.out)
                now = datetime.now(UTC)
                info = json.loads(row["_info"]) if row["_info"] else {}
                made.append({"part": part, "cell": key[0], "segment": key[1], "series_id": row["series_id"], "run_id": row["run_id"], "rows": 0, "first": row["_seq"], "info": info, "started": now.isoformat()})
                self.describe(made[-1], f"{part}.meta.json", part, False)
                due = time.monotonic() + DESCRIBE_EVERY
            out.writerow([cell_text(row[c]) for c in self.out])
            made[-1]["rows"] += 1
            if time.monotonic() >= due:
                file.flush()
                self.describe(made[-1], f"{part}.meta.json", part, False)
                due = time.monotonic() + DESCRIBE_EVERY
        if file:
            file.close()
        return Written(made)

    def describe(self, made: dict, target: str, path: str, finalized: bool) -> None:
        facts = redact_metadata(json.loads(self.options.get("metadata") or "{}") | made["info"])
        facts |= {"series_id": made["series_id"], "run_id": made["run_id"], "segment": made["segment"]}
        sidecar(target, path, facts, self.out, made["rows"], made["started"], finalized)

    def commit(self, messages: list) -> None:
        day = self.options.get("day") or datetime.now(UTC).strftime("%Y%m%d")
        files = sorted((f for m in messages if m for f in m.files), key=lambda f: f["first"])
        if not files and self.options.get("routed") != "true":
            # Samples of no series are one file, also where there are none: the header alone.
            part = os.path.join(self.options["path"], f".{self.job}-none.part")
            os.makedirs(self.options["path"], exist_ok=True)
            with open(part, "w", encoding="utf-8") as f:
                f.write(",".join(self.out) + "\n")
            files = [{"part": part, "cell": segment.DEFAULT, "segment": 1, "series_id": None, "run_id": None, "rows": 0, "info": {}, "started": datetime.now(UTC).isoformat()}]
        last: dict[str, int] = {}
        for made in files:
            path, last[made["cell"]] = claimed(self.options["path"], self.options.get("institution", "LOCAL"), made["cell"], day, last.get(made["cell"], 0) + 1)
            os.replace(made["part"], path)
            self.describe(made, path.removesuffix(".bdf.csv") + ".meta.json", path, True)
        self.sweep()

    def sweep(self) -> None:
        """Take away this job's hidden files, of killed and repeated attempts too."""
        for found in glob.glob(os.path.join(glob.escape(self.options["path"]), f".{self.job}-*")):
            with contextlib.suppress(FileNotFoundError):
                os.remove(found)

    def abort(self, messages: list) -> None:
        self.sweep()


def claimed(folder: str, institution: str, cell: str, day: str, first: int = 1) -> tuple[str, int]:
    """A new file name of this cell and day, created so that nobody else gets it, and its number: the first free one from ``first`` on.

    Numbers have three digits, beyond 999 as many as they need, so that no day is too long for its names.
    """
    n = first
    while True:
        path = os.path.join(folder, f"{institution}__{cell}__{day}_{n:03d}.bdf.csv")
        try:
            os.close(os.open(path, os.O_CREAT | os.O_EXCL | os.O_WRONLY))
            return path, n
        except FileExistsError:
            n += 1


def sidecar(target: str, path: str, metadata: dict, columns: list[str], rows: int, started: str, finalized: bool) -> None:
    """The description of a file, replaced as a whole."""
    from .. import __name__ as package

    facts = {"file": os.path.basename(path), "metadata": metadata, "started_at": started, "finished_at": datetime.now(UTC).isoformat() if finalized else None, "written_by": package, "columns": columns, "rows": rows, "finalized": finalized}
    with open(f"{target}.tmp", "w", encoding="utf-8") as f:
        json.dump(facts, f, indent=2)
    os.replace(f"{target}.tmp", target)


def write_feed(df: DataFrame, path: str, institution: str = "LOCAL", metadata: dict | None = None, rows_per_file: int | None = None, day: str | None = None, series_info: DataFrame | None = None, cell: str | None = None) -> None:
    """Write samples as feed files: one per segment, named by cell, day and number.

    ``path`` is a folder that driver and executors share (a mounted file system, as files are claimed
    by exclusive creation). Columns are the trio, then all else sorted. ``df`` has _seq; series_id and
    run_id where it is routed. ``series_info`` has series_id and, where known, cell_name; its other
    columns go into the descriptions of that series' files. ``cell`` names the files of samples without
    a series. No rows make no file, but one with the header alone where samples have no series.
    """
    spark = df.sparkSession
    routed = "series_id" in df.columns
    for c in names.RESERVED:
        df = df if c in df.columns else df.withColumn(c, F.lit(None).cast("string"))
    df = segment.with_segments(df, rows_per_file)
    series = df.groupBy("series_id").agg(F.min("_seq").alias("first_seq"))
    info = F.lit(None).cast("string")
    if series_info is not None:
        facts = [F.col(c) for c in series_info.columns if c not in ("series_id", "cell_name")]
        named = F.col("cell_name") if "cell_name" in series_info.columns else F.lit(None).cast("string")
        told = series_info.select(F.col("series_id").alias("__sid"), named.alias("__name"), (F.to_json(F.struct(*facts)) if facts else info).alias("_info")).dropDuplicates(["__sid"])
        series = series.join(told, F.col("series_id").eqNullSafe(F.col("__sid")), "left").drop("__sid")
        info = F.col("_info")
    else:
        series = series.withColumn("__name", F.lit(None).cast("string"))
    wanted = F.coalesce("__name", "series_id", *([F.lit(cell)] if cell else []))
    cells = segment.cell_names(series.withColumn("__as", wanted), "__as").select(F.col("series_id").alias("__id"), F.col("cell").alias("_cell"), info.alias("_info"))
    df = df.join(cells, F.col("series_id").eqNullSafe(F.col("__id"))).drop("__id")
    rest = names.ordered_columns(set(df.columns) - set(INNER))
    cols = [F.col(f"`{c}`") if c in df.columns else F.lit(None).cast("double").alias(c) for c in rest]
    out = df.select(*names.RESERVED, "_seq", *INNER, *cols).repartition("_cell", "segment").sortWithinPartitions("_cell", "segment", "_seq")
    spark.dataSource.register(FeedSource)
    options = {"path": path, "institution": institution, "metadata": json.dumps(metadata or {}), "routed": str(routed).lower()} | ({"day": day} if day else {})
    out.write.format("feed").options(**options).mode("append").save()
