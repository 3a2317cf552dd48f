"""Frames out of byte streams that were cut anywhere: whole streams as tables, or live ones with what is left over as state.

A reader of such a stream looks for the next sound frame from where the last one ended. So frames
are greedy choices among all places at which a sound frame could begin, one frame's length apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.frames import BLE_LENGTH, HEADER, reassemble
from ..scratch import stored
from .greedy import greedy

#: Bytes of a stream that one task looks at together; pieces of a stream whose lengths are summed up in one task.
PAGE, BLOCK = 1 << 20, 1 << 20


def placed(chunks: DataFrame, device: str, chunk: str, data: str, block: int = BLOCK) -> DataFrame:
    """(device, start, data): each piece and its place in the device's stream. Sums of blocks of pieces are carried on."""
    df = chunks.select(F.col(device).alias("device"), F.col(chunk).alias("chunk"), F.coalesce(F.col(data), F.lit(b"")).alias("data")).withColumn("block", F.floor(F.col("chunk") / block))
    sums = df.groupBy("device", "block").agg(F.sum(F.length("data")).alias("n"))
    earlier = Window.partitionBy("device").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("device").alias("of"), F.col("block").alias("at"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    df = df.join(sums, F.col("device").eqNullSafe(F.col("of")) & (F.col("block") == F.col("at")))
    here = Window.partitionBy("device", "block").orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)
    return df.select("device", (F.col("before") + F.sum(F.length("data")).over(here) - F.length("data")).alias("start"), "data")


def _sound(length: int, page: int):
    def run(group: pa.Table) -> pa.Table:
        """The places of a page at which a sound frame begins, and those frames."""
        group = group.sort_by("start")
        data = np.frombuffer(b"".join(group.column("data").to_pylist()), np.uint8)
        at = np.flatnonzero(data[: max(0, min(page, len(data) - length + 1))] == HEADER)
        sums = np.append(0, np.cumsum(data, dtype=np.int64))
        at = at[(sums[at + length - 1] - sums[at]) & 255 == data[at + length - 1]]
        first = group.column("start")[0].as_py()
        return pa.table({"device": pa.array([group.column("device")[0].as_py()] * len(at), pa.string()), "place": at + first, "frame": pa.array([data[k : k + length].tobytes() for k in at], pa.binary())})

    return run


def candidates(pieces: DataFrame, length: int = BLE_LENGTH, page: int = PAGE) -> DataFrame:
    """(device, place, frame) wherever a frame with header and checksum could begin. A page also has the first bytes of the next one."""
    end = F.col("start") + F.length("data")
    pages = F.sequence(F.greatest(F.floor((F.col("start") - length + 1) / page), F.lit(0)), F.floor((end - 1) / page))
    cut = pieces.where(F.length("data") > 0).withColumn("page", F.explode(pages))
    first = F.greatest(F.col("start"), F.col("page") * page)
    last = F.least(end, (F.col("page") + 1) * page + length - 1)
    cut = cut.select("device", "page", first.alias("start"), F.expr("data").substr((first - F.col("start") + 1).cast("int"), (last - first).cast("int")).alias("data"))
    return cut.groupBy("device", "page").applyInArrow(_sound(length, page), "device string, place long, frame binary")


def framed(chunks: DataFrame, device: str = "device", chunk: str = "chunk", data: str = "data", length: int = BLE_LENGTH, page: int = PAGE) -> DataFrame:
    """(device, place, frame): the frames that a reader finds in each device's stream, whose pieces are ordered by ``chunk``.

    Null pieces are empty; a null device is one stream. What is left over at the end gives no frame.
    """
    found = stored(candidates(placed(chunks, device, chunk, data), length, page), "frames-found")
    kept = greedy(found, ["device"], "place", length).select(F.col("device").alias("of"), F.col("place").alias("at"))
    return found.join(kept, F.col("device").eqNullSafe(F.col("of")) & (F.col("place") == F.col("at")), "left_semi")


class Framer(StatefulProcessor):
    """State of a device: the bytes after its last frame that may begin another, fewer than a frame has, and the frames so far."""

    def __init__(self, length: int):
        self.length = length

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("rest", "rest binary, frames long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803 -- Spark's names
        rest, n = self.state.get() if self.state.exists() else (b"", 0)
        made = Row("device", "frame_no", "frame")
        for row in sorted(rows, key=lambda r: r["chunk"]):
            frames, rest = reassemble(bytes(rest) + bytes(row["data"] or b""), self.length)
            for frame in frames:
                yield made(key[0], n, bytearray(frame))
                n += 1
        self.state.update((bytearray(rest), n))

    def close(self) -> None:
        pass


def framed_stream(chunks: DataFrame, length: int = BLE_LENGTH) -> DataFrame:
    """(device, frame_no, frame) of a stream of (device, chunk, data), however it was cut. Needs the RocksDB state store."""
    df = chunks.select("device", "chunk", "data")
    return df.groupBy("device").transformWithState(statefulProcessor=Framer(length), outputStructType="device string, frame_no long, frame binary", outputMode="Append", timeMode="None")
