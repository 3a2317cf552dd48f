"""Rows pushed as JSON lines over HTTP, at least once; what cannot be delivered is spooled."""

from __future__ import annotations

import gzip
import os
import socket
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Sequence
from datetime import UTC, datetime

from pyspark.sql import DataFrame

from ..functions.redact import header_value, json_row


def post(url: str, lines: Sequence[str], token: str | None = None, headers: dict[str, str] | None = None, timeout: float = 10.0, compress: bool = True) -> bool:
    """One request with all lines; True for a 2xx answer. Network errors are False, not raised."""
    body = ("\n".join(lines) + "\n").encode()
    sent = {"Content-Type": "application/x-ndjson"} | {k: header_value(k, v) for k, v in (headers or {}).items()}
    if token:
        sent["Authorization"] = f"Bearer {header_value('token', token)}"
    if compress:
        body, sent["Content-Encoding"] = gzip.compress(body), "gzip"
    try:
        with urllib.request.urlopen(urllib.request.Request(url, data=body, headers=sent, method="POST"), timeout=timeout) as answer:
            return 200 <= answer.status < 300
    except (urllib.error.URLError, OSError):
        return False


def spool(lines: Sequence[str], folder: str | None = None) -> str:
    """The lines in a new file; the working folder where the given one cannot be written."""
    stem = f"{socket.gethostname()}-{datetime.now(UTC):%Y%m%dT%H%M%SZ}"
    for base in dict.fromkeys((folder or ".", ".")):
        for n in range(1000):
            path = os.path.join(base, f"{stem}{f'-{n}' if n else ''}.spool.ndjson")
            try:
                os.makedirs(base, exist_ok=True)
                with open(path, "x", encoding="utf-8") as f:
                    f.write("\n".join(lines) + "\n")
                return path
            except FileExistsError:
                continue
            except OSError:
                break
    raise OSError("no folder to spool to")


class Pusher:
    """A bounded buffer of lines, flushed by cadence; for use by one writer."""

    def __init__(self, url: str, batch_seconds: float = 15.0, max_rows: int = 100_000, spool_dir: str | None = None, delays: Sequence[float] = (2.0, 4.0), clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep, **request):
        self.url, self.every, self.max_rows, self.spool_dir, self.delays, self.clock, self.sleep, self.request = url, batch_seconds, max_rows, spool_dir, delays, clock, sleep, request
        self.lines: list[str] = []
        self.flushed, self.spooled = clock(), []

    def write(self, lines: Sequence[str]) -> None:
        self.lines += lines
        if len(self.lines) > self.max_rows:
            over = len(self.lines) - self.max_rows
            self.spooled.append(spool(self.lines[:over], self.spool_dir))
            del self.lines[:over]
        if self.clock() - self.flushed >= self.every:
            self.flush()

    def flush(self) -> bool:
        self.flushed = self.clock()
        if self.lines and not post(self.url, self.lines, **self.request):
            return False
        self.lines.clear()
        return True

    def close(self) -> None:
        for delay in (*self.delays, None):
            if self.flush():
                return
            if delay is not None:
                self.sleep(delay)
        self.spooled.append(spool(self.lines, self.spool_dir))
        self.lines.clear()


def push_rows(df: DataFrame, url: str, spool_dir: str, rows_per_request: int = 5000, **request) -> DataFrame:
    """Post all rows, each task on its own; returns (rows, delivered) per request.

    A repeated task posts again: delivery is at least once. ``spool_dir`` must be a folder that
    outlives executors; a task's own working folder would vanish with it, so there is no default.
    """
    if not spool_dir:
        raise ValueError("spool_dir must name a shared folder")
    lines = df.select(json_row(dict(df.dtypes)).alias("value"))

    def run(batches):
        import pandas as pd

        def send(part: list[str]) -> pd.DataFrame:
            ok = post(url, part, **request)
            if not ok:
                spool(part, spool_dir)
            return pd.DataFrame({"rows": [len(part)], "delivered": [ok]})

        held: list[str] = []
        for batch in batches:
            held += batch["value"].tolist()
            while len(held) >= rows_per_request:
                yield send(held[:rows_per_request])
                held = held[rows_per_request:]
        if held:
            yield send(held)

    return lines.mapInPandas(run, "rows long, delivered boolean")
