"""What was delivered and what waits: a folder that makes repeated tasks post nothing twice, and loses nothing that failed.

Each request of a task has a place: run, epoch, partition and first row. Its outcome is noted there
with a digest of its lines once it is known. A task that is repeated passes over requests that are
noted for the same lines; another cut of the rows is posted again, so nothing is left out. Requests
carry their place as ``Idempotency-Key``, for the moment between an answer and its note. What cannot
be delivered waits in files, one a request, until :func:`drain` sends it.
"""

from __future__ import annotations

import contextlib
import hashlib
import json
import os
import shutil
import time
import uuid
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from ..functions.redact import json_row
from .push import post

NOTE = "rows long, state string"
SPOOLED = ".spool.ndjson"


def digest(lines: Sequence[str]) -> str:
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


class Outbox:
    """The notes and waiting files of one run, in a mounted folder that outlives executors."""

    def __init__(self, folder: str, run: str):
        if not folder:
            raise ValueError("an outbox needs a shared folder")
        self.folder, self.run = folder, run
        self.notes = os.path.join(folder, "delivered", run)

    def noted(self, epoch: int, partition: int) -> dict[int, tuple[str, str]]:
        """First row -> (digest, state) of the requests of a task; a note that was torn off counts as none."""
        found = {}
        with contextlib.suppress(FileNotFoundError), open(os.path.join(self.notes, str(epoch), f"{partition}.ndjson"), encoding="utf-8") as f:
            for line in f:
                with contextlib.suppress(ValueError, KeyError):
                    note = json.loads(line)
                    found[note["first"]] = (note["sha"], note["state"])
        return found

    def note(self, epoch: int, partition: int, first: int, lines: Sequence[str], state: str) -> None:
        os.makedirs(os.path.join(self.notes, str(epoch)), exist_ok=True)
        told = json.dumps({"first": first, "rows": len(lines), "sha": digest(lines), "state": state})
        with open(os.path.join(self.notes, str(epoch), f"{partition}.ndjson"), "a", encoding="utf-8") as f:
            f.write(f"\n{told}\n")  # a line of its own, also after one that was torn off
            f.flush()
            os.fsync(f.fileno())

    def spool(self, epoch: int, partition: int, first: int, lines: Sequence[str]) -> None:
        """The lines in the one file of their place: an attempt that is repeated replaces it."""
        os.makedirs(self.folder, exist_ok=True)
        path = os.path.join(self.folder, f"{self.run}-{epoch}-{partition}-{first}")
        with open(f"{path}.{uuid.uuid4().hex}.tmp", "w", encoding="utf-8") as f:
            f.write("\n".join(lines) + "\n")
            f.flush()
            os.fsync(f.fileno())
        os.replace(f.name, path + SPOOLED)

    def forget(self, epoch: int) -> None:
        """Remove the notes of epochs before one that has begun: they cannot come again."""
        with contextlib.suppress(FileNotFoundError):
            for name in os.listdir(self.notes):
                if name.isdigit() and int(name) < epoch:
                    shutil.rmtree(os.path.join(self.notes, name), ignore_errors=True)


def deliver(df: DataFrame, url: str, outbox: str, run: str, epoch: int = 0, rows_per_request: int = 5000, delays: Sequence[float] = (2.0, 4.0), **request) -> DataFrame:
    """Post all rows as JSON lines, each task on its own; returns (rows, state) of each request: ``sent``, ``spooled`` or ``known``.

    A request that fails is tried again after each of ``delays``, then its lines wait in the outbox.
    The result is lazy: rows are posted when it is read. Rows should come in an order that a repeated
    task gives again, or they are posted again.
    """
    box = Outbox(outbox, run)
    lines = df.select(json_row(dict(df.dtypes)).alias("value"))

    def send(partition: int, first: int, part: list[str], known: dict) -> tuple[int, str]:
        if known.get(first, (None,))[0] == digest(part):
            return len(part), "known"
        headers = dict(request.get("headers") or {}) | {"Idempotency-Key": f"{run}-{epoch}-{partition}-{first}-{len(part)}"}
        for wait in (*delays, None):
            if post(url, part, **(request | {"headers": headers})):
                box.note(epoch, partition, first, part, "sent")
                return len(part), "sent"
            if wait is not None:
                time.sleep(wait)
        box.spool(epoch, partition, first, part)
        box.note(epoch, partition, first, part, "spooled")
        return len(part), "spooled"

    def run_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        partition = TaskContext.get().partitionId()
        known, first = box.noted(epoch, partition), 0
        held: list[str] = []
        for batch in batches:
            held += batch["value"].tolist()
            while len(held) >= rows_per_request:
                yield pd.DataFrame([send(partition, first, held[:rows_per_request], known)], columns=["rows", "state"])
                first, held = first + rows_per_request, held[rows_per_request:]
        if held:
            yield pd.DataFrame([send(partition, first, held, known)], columns=["rows", "state"])

    return lines.mapInPandas(run_task, NOTE)


def deliver_stream(df: DataFrame, url: str, outbox: str, checkpoint: str, once: bool = False, interval: str = "15 seconds", **options):
    """Start a query that delivers each micro-batch; a batch that is repeated posts what is not noted yet."""
    run = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def batch(rows: DataFrame, epoch: int) -> None:
        deliver(rows, url, outbox, run, epoch, **options).collect()  # one row a request
        Outbox(outbox, run).forget(epoch)

    out = df.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out.trigger(processingTime=interval)).start()


def waiting(outbox: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files that wait, those that a drain was killed over among them."""
    names = sorted(x for x in (os.listdir(outbox) if os.path.isdir(outbox) else []) if x.endswith(SPOOLED))
    return [(os.path.join(outbox, x), os.path.getsize(os.path.join(outbox, x))) for x in names]


def drain(spark: SparkSession, url: str, outbox: str, rows_per_request: int = 5000, bytes_per_task: int = 64 << 20, **request) -> DataFrame:
    """Send what waits; returns (files, rows, delivered, left) of each task, as a table that was computed.

    Small files are put together, so that a task sends full requests. What a task could not deliver
    is left in one file instead of many. A task that is lost over it sends again what it had sent.
    One drain at a time.
    """
    groups: list[tuple[int, str]] = []
    size, k = 0, 0
    for path, n in waiting(outbox):
        if size and size + n > bytes_per_task:
            size, k = 0, k + 1
        groups.append((k, path))
        size += n
    schema = "files long, rows long, delivered long, left long"
    if not groups:
        return spark.createDataFrame([], schema)

    def send(group: pd.DataFrame) -> pd.DataFrame:
        paths, lines = sorted(group["path"]), []
        for path in paths:
            with contextlib.suppress(FileNotFoundError), open(path, encoding="utf-8", newline="\n") as f:
                lines += [x.rstrip("\n") for x in f]
        left: list[str] = []
        for first in range(0, len(lines), rows_per_request):
            part = lines[first : first + rows_per_request]
            headers = dict(request.get("headers") or {}) | {"Idempotency-Key": f"drain-{digest(part)}"}
            if not post(url, part, **(request | {"headers": headers})):
                left += part
        if left:
            # The remainder is there before the files that it came from go.
            name = os.path.join(outbox, f"left-{digest(left)[:32]}")
            with open(f"{name}.tmp", "w", encoding="utf-8") as f:
                f.write("\n".join(left) + "\n")
            os.replace(f"{name}.tmp", name + SPOOLED)
        for path in paths:
            if not left or path != name + SPOOLED:
                with contextlib.suppress(FileNotFoundError):
                    os.remove(path)
        return pd.DataFrame({"files": [len(paths)], "rows": [len(lines)], "delivered": [len(lines) - len(left)], "left": [len(left)]})

    listing = spark.createDataFrame(groups, "k long, path string")
    done = listing.groupBy("k").applyInPandas(send, schema).collect()  # one row a task
    return spark.createDataFrame(done, schema)
