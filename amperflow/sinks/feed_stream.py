"""Feed files of a stream: open files go on from epoch to epoch, and every epoch counts once.

Tasks write an epoch's rows behind what is committed of their series' open file, or into a hidden
file where a segment begins. A repeated or doubled attempt writes the same bytes at the same place.
The commit on the driver handles names and lengths, no rows: it claims names for new segments in
order of arrival, cuts files to their committed length, writes descriptions, and last of all
replaces the number of the committed epoch. What was written under a higher number is not there.
"""

from __future__ import annotations

import contextlib
import csv
import glob
import hashlib
import io
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSourceStreamWriter, WriterCommitMessage
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from .. import schema as names
from ..functions import text
from ..functions.redact import redact_metadata
from ..operators.segment import DEFAULT

#: Columns that carry names and facts, and are no cells of the files.
INNER = ("segment", "_base", "_info")
BUFFER = 1 << 20


@dataclass
class Appended(WriterCommitMessage):
    files: list


def digest(series: str | None) -> str:
    """What a series' own files are called: no two series share it, and none that of rows without a series."""
    return "none" if series is None else hashlib.sha256(series.encode()).hexdigest()


def replaced(path: str, content: str) -> None:
    """A small file, written beside its place and put there in one step."""
    with open(f"{path}.tmp", "w", encoding="utf-8") as f:
        f.write(content)
        f.flush()
        os.fsync(f.fileno())
    os.replace(f"{path}.tmp", path)


class Runs:
    """What is committed: ``epoch`` and, for each series, the files of its last two epochs (the last file is the open one)."""

    def __init__(self, folder: str, run: str):
        self.folder, self.state = folder, os.path.join(folder, f".feed-{run}")

    def epoch(self) -> int:
        try:
            with open(os.path.join(self.state, "epoch"), encoding="utf-8") as f:
                return int(f.read())
        except FileNotFoundError:
            return -1

    def versions(self, key: str) -> list[dict]:
        try:
            with open(os.path.join(self.state, f"{key}.json"), encoding="utf-8") as f:
                return json.load(f)
        except FileNotFoundError:
            return []

    def committed(self, key: str, epoch: int) -> dict | None:
        """The newest version of a series that is not beyond ``epoch``."""
        found = [v for v in self.versions(key) if v["epoch"] <= epoch]
        return max(found, key=lambda v: v["epoch"]) if found else None

    def put(self, key: str, epoch: int, files: list[dict], before: dict | None) -> None:
        replaced(os.path.join(self.state, f"{key}.json"), json.dumps([*([before] if before else []), {"epoch": epoch, "files": files}]))

    def cell(self, series: str | None, base: str) -> str:
        """A cell name that is this series' alone, without regard to case: the first to ask keeps the plain name."""
        os.makedirs(os.path.join(self.state, "names"), exist_ok=True)
        me = json.dumps(series)
        reserved = base.casefold() == DEFAULT and series is not None
        tries = ([] if reserved else [base]) + [f"{base}-{digest(series)[:n]}" for n in (8, 16, 32, 64)]
        for name in tries:
            path = os.path.join(self.state, "names", name.casefold())
            with contextlib.suppress(FileExistsError):
                os.close(os.open(path, os.O_CREAT | os.O_EXCL | os.O_WRONLY))
                replaced(path, me)
                return name
            with open(path, encoding="utf-8") as f:
                if f.read() in (me, ""):  # empty: this driver died between the two steps
                    replaced(path, me)
                    return name
        raise RuntimeError(f"no free cell name for series {series!r}")


class FeedStreamWriter(DataSourceStreamWriter):
    """Rows come by series and segment, in order; see :func:`stream_feed`."""

    def __init__(self, schema: StructType, options: dict):
        columns = [f.name for f in schema.fields]
        self.out = [c for c in columns if c not in (*names.RESERVED, *names.ARRIVAL, *INNER)]
        self.options = options

    def runs(self) -> Runs:
        return Runs(self.options["path"], self.options["run"])

    def write(self, iterator: Iterator) -> Appended:
        from .feed import cell_text

        runs, made, at, file, out = self.runs(), [], None, None, None
        epoch = runs.epoch()
        buffer = io.StringIO()

        def flush() -> None:
            file.write(buffer.getvalue().encode("utf-8"))
            made[-1]["end"] = file.tell()
            buffer.seek(0)
            buffer.truncate()

        for row in iterator:
            key = (row["series_id"], row["segment"])
            if file is None or key != at:
                if file:
                    flush()
                    file.close()
                at, me = key, digest(key[0])
                held = runs.committed(me, epoch)
                last = held["files"][-1] if held else None
                goes_on = last is not None and last["segment"] == key[1]
                path = last["path"] if goes_on else os.path.join(runs.state, f"{me}-{key[1]}.part")
                os.makedirs(runs.state, exist_ok=True)
                # Neither cut nor appended: bytes are put where they belong.
                file = os.fdopen(os.open(path, os.O_CREAT | os.O_WRONLY, 0o644), "wb")
                file.seek(last["length"] if goes_on else 0)
                out = csv.writer(buffer, lineterminator="\n")
                if not goes_on:
                    out.writerow(self.out)
                made.append({"series_id": key[0], "run_id": row["run_id"], "segment": key[1], "first": row["_seq"], "rows": 0, "end": 0, "base": row["_base"], "info": json.loads(row["_info"]) if row["_info"] else {}, "part": None if goes_on else path})
            out.writerow([cell_text(row[c]) for c in self.out])
            made[-1]["rows"] += 1
            if buffer.tell() >= BUFFER:
                flush()
        if file:
            flush()
            file.close()
        return Appended(made)

    def commit(self, messages: list, batchId: int) -> None:  # noqa: N803 -- Spark's name
        from .feed import claimed

        runs, epoch = self.runs(), int(batchId)
        os.makedirs(runs.state, exist_ok=True)
        files = sorted((f for m in messages if m for f in m.files), key=lambda f: (f["first"] is None, f["first"]))
        if epoch <= runs.epoch():
            self.undo(files, runs)
            return
        day = self.options.get("day") or datetime.now(UTC).strftime("%Y%m%d")
        most = int(self.options.get("rows") or 0)
        under_way: dict[str, tuple[dict | None, list[dict], dict]] = {}
        for made in files:
            me = digest(made["series_id"])
            if me not in under_way:
                again = {f["segment"]: f for v in runs.versions(me) if v["epoch"] == epoch for f in v["files"]}
                before = runs.committed(me, epoch - 1)
                under_way[me] = before, ([before["files"][-1]] if before else []), again
            before, state, again = under_way[me]
            if made["part"] is None:
                state[-1] = state[-1] | {"rows": state[-1]["rows"] + made["rows"], "length": made["end"], "open": True}
            else:
                for old in state[-1:]:
                    if old["open"]:
                        state[-1] = old | {"open": False}
                        self.describe(state[-1])
                known = again.get(made["segment"])
                cell = known["cell"] if known else state[-1]["cell"] if state else runs.cell(made["series_id"], made["base"])
                path = known["path"] if known else claimed(self.options["path"], self.options.get("institution", "LOCAL"), cell, day)[0]
                state.append({k: made[k] for k in ("series_id", "run_id", "segment", "info", "rows")} | {"cell": cell, "path": path, "length": made["end"], "started": datetime.now(UTC).isoformat(), "open": True})
                runs.put(me, epoch, state, before)  # before the name is used: a repeated commit finds it here
                os.replace(made["part"], path)
            os.truncate(state[-1]["path"], state[-1]["length"])
            if most and state[-1]["rows"] >= most:
                state[-1]["open"] = False
            self.describe(state[-1])
        for me, (before, state, _) in under_way.items():
            runs.put(me, epoch, state, before)
        replaced(os.path.join(runs.state, "epoch"), str(epoch))

    def describe(self, file: dict) -> None:
        from .feed import sidecar

        facts = redact_metadata(json.loads(self.options.get("metadata") or "{}") | file["info"])
        facts |= {k: file[k] for k in ("series_id", "run_id", "segment")}
        sidecar(file["path"].removesuffix(".bdf.csv") + ".meta.json", file["path"], facts, self.out, file["rows"], file["started"], not file["open"])

    def undo(self, files: list, runs: Runs) -> None:
        """Take back what tasks wrote that is not committed."""
        for made in files:
            held = runs.committed(digest(made["series_id"]), runs.epoch())
            if made["part"] is None and held:
                os.truncate(held["files"][-1]["path"], held["files"][-1]["length"])
            elif made["part"]:
                with contextlib.suppress(FileNotFoundError):
                    os.remove(made["part"])

    def abort(self, messages: list, batchId: int) -> None:  # noqa: N803
        self.undo([f for m in messages if m for f in m.files], self.runs())

    def finish(self) -> int:
        """Cut every open file to what is committed and describe it as final; returns how many there were."""
        runs, n = self.runs(), 0
        epoch = runs.epoch()
        for path in glob.glob(os.path.join(glob.escape(runs.state), "*.json")):
            key = os.path.basename(path).removesuffix(".json")
            held = runs.committed(key, epoch)
            if held and held["files"][-1]["open"]:
                last = held["files"][-1]
                os.truncate(last["path"], last["length"])
                self.describe(last | {"open": False})
                n += 1
        for part in glob.glob(os.path.join(glob.escape(runs.state), "*.part")):
            os.remove(part)
        return n


@dataclass
class FeedStream:
    """A running query that writes feed files, and what ends them."""

    query: StreamingQuery
    writer: FeedStreamWriter

    def finish(self) -> int:
        """Stop the query and finish its open files."""
        self.query.stop()
        return self.writer.finish()


def stream_feed(df: DataFrame, path: str, checkpoint: str, institution: str = "LOCAL", metadata: dict | None = None, rows_per_file: int | None = None, seconds_per_file: float | None = None, day: str | None = None, series_info: DataFrame | None = None, cell: str | None = None, once: bool = False, interval: str = "10 seconds") -> FeedStream:
    """Start a stream of samples into feed files, one for each segment, as :func:`amperflow.sinks.feed.write_feed` writes a batch.

    Segments, and the files that are open, go on across micro-batches and restarts from the same
    ``checkpoint``; state is kept by series, so that a series is one task's work in a micro-batch.
    A segment ends with its run, after ``rows_per_file`` rows, or, where rows of a micro-batch begin,
    at an age of ``seconds_per_file``. Needs the RocksDB state store, and a mounted folder.
    """
    from ..streaming.segmenter import segmented_stream
    from .feed import FeedSource

    spark = df.sparkSession
    for c in names.RESERVED:
        df = df if c in df.columns else df.withColumn(c, F.lit(None).cast("string"))
    name, info = F.lit(None).cast("string"), F.lit(None).cast("string")
    rest = names.ordered_columns(set(df.columns))
    if series_info is not None:
        facts = [F.col(c) for c in series_info.columns if c not in ("series_id", "cell_name")]
        told = series_info.select(F.col("series_id").alias("__sid"), (F.col("cell_name") if "cell_name" in series_info.columns else name).alias("__name"), (F.to_json(F.struct(*facts)) if facts else info).alias("__info")).dropDuplicates(["__sid"])
        df = df.join(told, F.col("series_id").eqNullSafe(F.col("__sid")), "left")
        name, info = F.col("__name"), F.col("__info")
    wanted = F.coalesce(name, "series_id", *([F.lit(cell)] if cell else []))
    base = F.when(wanted.isNull(), DEFAULT).otherwise(text.cell_name(wanted))
    cols = [F.col(f"`{c}`") if c in df.columns else F.lit(None).cast("double").alias(c) for c in rest]
    out = segmented_stream(df.select(*names.RESERVED, "_seq", base.alias("_base"), info.alias("_info"), *cols), rows_per_file, seconds_per_file)
    spark.dataSource.register(FeedSource)
    run = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]
    options = {"path": path, "run": run, "institution": institution, "metadata": json.dumps(metadata or {})} | ({"day": day} if day else {}) | ({"rows": str(rows_per_file)} if rows_per_file else {})
    stream = out.writeStream.format("feed").options(**options).option("checkpointLocation", checkpoint).outputMode("append")
    query = (stream.trigger(availableNow=True) if once else stream.trigger(processingTime=interval)).start()
    return FeedStream(query, FeedStreamWriter(out.schema, options))
