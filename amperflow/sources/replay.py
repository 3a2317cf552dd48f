"""Recorded tapes as a stream: frames come when they came, faster or at once.

How far a tape has got is a function of the clock: the seconds since its anchor, times the pace. As
frames are in order of time, the bytes up to a time are found by halving, without reading the tape;
a micro-batch is a range of bytes, cut into splits that tasks read. The anchor is a small file, so
that a stream that goes on from its checkpoint goes on in its tape.
"""

from __future__ import annotations

import json
import math
import os
import time
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

SPLIT = 32 << 20
SCHEMA = "t double, data binary, meta string, _seq bigint"


def frame(line: bytes) -> tuple[float, bytes, str | None] | None:
    """(t, data, meta) of a line, None where it is no frame."""
    try:
        found = json.loads(line)
        t, data, meta = found["t"], bytes.fromhex(found["data"]), found.get("meta")
        if isinstance(t, bool) or not isinstance(t, (int, float)) or not math.isfinite(t) or t < 0 or not (meta is None or isinstance(meta, dict)):
            return None
        return float(t), data, None if meta is None else json.dumps(meta, separators=(",", ":"), ensure_ascii=False)
    except (ValueError, KeyError, TypeError):
        return None


def lines_from(file, at: int, until: int) -> Iterator[tuple[int, bytes]]:
    """(place, line) of the whole lines that begin at ``at`` or later and before ``until``; a last line without an end is under way."""
    file.seek(max(at - 1, 0))
    place = at if at == 0 else at - 1 + len(file.readline())  # the line that ``at`` lies in belongs to what comes before
    while place < until and (line := file.readline()).endswith(b"\n"):
        yield place, line
        place += len(line)


def reached(path: str, t: float) -> int:
    """The place behind the last whole line whose frame is not later than ``t``, found by halving; lines that are no frames go with those before them."""
    size = os.path.getsize(path) if os.path.exists(path) else 0
    if not size:
        return 0
    with open(path, "rb") as f:
        low, high = 0, size  # all lines that begin before ``low`` are reached, none that begins at ``high`` or later
        while low < high:
            middle = (low + high) // 2
            later = next(((p, len(x), found[0]) for p, x in lines_from(f, middle, high) if (found := frame(x))), None)
            if later is None:
                # No frame begins in the upper half: look for the last one in the lower, then take in what follows it.
                high = middle
            elif later[2] <= t:
                low = later[0] + later[1]
            else:
                high = middle
        end = low
        for p, line in lines_from(f, low, size):
            if (found := frame(line)) and found[0] > t:
                break
            end = p + len(line)
        return end


@dataclass
class Piece(InputPartition):
    start: int
    end: int


class TapeSource(DataSource):
    """``format("tape")``: options path, pace (times as fast as recorded; 0: at once), anchor (a small file, for streams), split (bytes).

    Rows are frames: t, data, meta, and ``_seq``, the frame's place in the tape. Lines that are no
    frames are passed over (``read_tape`` tells of them); a line under way waits. The tape must be
    readable by driver and executors.
    """

    @classmethod
    def name(cls) -> str:
        return "tape"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Batch(dict(self.options))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802 -- Spark's name
        return _Stream(dict(self.options))


class _Reading:
    def __init__(self, options: dict):
        self.path, self.split = options["path"], int(options.get("split", SPLIT))
        self.pace, self.anchor = float(options.get("pace", 0)), options.get("anchor")

    def pieces(self, start: int, end: int) -> list[Piece]:
        return [Piece(at, min(at + self.split, end)) for at in range(start, end, self.split)]

    def read(self, partition: Piece | None) -> Iterator[tuple]:
        if partition is None:  # Spark reads one None where there is no piece
            return
        with open(self.path, "rb") as f:
            for place, line in lines_from(f, partition.start, partition.end):
                if found := frame(line):
                    yield (*found, place)


class _Batch(_Reading, DataSourceReader):
    def partitions(self) -> list[Piece]:
        return self.pieces(0, os.path.getsize(self.path))


class _Stream(_Reading, DataSourceStreamReader):
    def initialOffset(self) -> dict:  # noqa: N802
        return {"byte": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        t = math.inf
        if self.pace > 0:
            if not os.path.exists(self.anchor):
                with open(f"{self.anchor}.tmp", "w", encoding="utf-8") as f:
                    json.dump({"began": time.time()}, f)
                os.replace(f"{self.anchor}.tmp", self.anchor)
            with open(self.anchor, encoding="utf-8") as f:
                t = (time.time() - json.load(f)["began"]) * self.pace
        return {"byte": reached(self.path, t)}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        return self.pieces(start["byte"], end["byte"])


def replayed(spark: SparkSession, path: str, pace: float = 0.0, anchor: str | None = None, split: int = SPLIT) -> DataFrame:
    """The frames of a tape as a stream, ``pace`` times as fast as they were recorded, or at once.

    ``anchor`` says when the tape began to play; it is made on the first start. Frames of the time in
    which a stream was stopped come when it goes on.
    """
    if pace < 0 or (pace > 0 and not anchor):
        raise ValueError("a paced replay needs a positive pace and an anchor")
    spark.dataSource.register(TapeSource)
    reader = spark.readStream.format("tape").option("path", path).option("pace", pace).option("split", split)
    return (reader.option("anchor", anchor) if anchor else reader).load()
