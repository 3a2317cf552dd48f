"""Recorded frames as JSON lines: {"t": seconds, "data": hex, "meta": object or absent}."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

#: Lines that are checked together.
BLOCK = 1 << 17


def read_tape(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(frames, faults) of a tape: line, t, data, meta; and line, fault.

    ``path`` is a file, or a folder whose files are the tape's parts by name. They are read in splits;
    line numbers are carried from split to split, and the times reached from block to block of lines.

    Blank lines are skipped. A last line that is no JSON was torn off while being written and is no
    fault. Frames must not go back in time.
    """
    place = ("__file", "__block")
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__id"))
    splits = Window.orderBy(*place).rowsBetween(Window.unboundedPreceding, -1)  # one row a split of the file
    # A split is read by one task from end to end, so its lines have numbers without a gap, and nothing need be sorted.
    first = raw.groupBy(*place).agg(F.count("*").alias("__n"), F.min("__id").alias("__least")).withColumn("__first", F.coalesce(F.sum("__n").over(splits), F.lit(0))).drop("__n")
    text = raw.join(F.broadcast(first), list(place)).withColumn("line", F.col("__first") + F.col("__id") - F.col("__least") + 1).where(F.trim("value") != "")
    parsed = text.withColumn("v", F.try_parse_json("value"))
    last = parsed.agg(F.max("line").alias("last"))
    t = F.try_variant_get("v", "$.t", "double")
    kind = F.schema_of_variant(F.try_variant_get("v", "$.t", "variant"))
    data = F.try_variant_get("v", "$.data", "string")
    meta = F.try_variant_get("v", "$.meta", "variant")
    binary = F.when(data.rlike("^[0-9a-fA-F]*+$") & (F.length(data) % 2 == 0), F.unhex(data))
    df = parsed.crossJoin(F.broadcast(last)).select(  # one row
        F.floor(F.col("line") / BLOCK).alias("__part"), "line", "last", F.col("v").isNull().alias("torn"), t.alias("t"), kind.alias("kind"), binary.alias("data"), meta.alias("meta"), F.schema_of_variant(meta).alias("meta_kind")
    )
    # The latest time of all lines before: of the block's own, and of those of earlier blocks.
    blocks = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row a block
    reached = df.groupBy("__part").agg(F.max("t").alias("__t")).withColumn("__reached", F.max("__t").over(blocks)).drop("__t")
    df = df.join(reached, "__part")
    before = F.greatest(F.max("t").over(Window.partitionBy("__part").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)), F.col("__reached"))
    fault = (
        F.when(F.col("torn") & (F.col("line") == F.col("last")), None).when(F.col("torn"), "not JSON").when(F.col("t").isNull() | ~F.col("kind").rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), "t is no number")
        .when(F.col("t") < 0, "t is negative").when(F.col("data").isNull(), "data is no hex").when(F.col("meta_kind").isNotNull() & ~F.col("meta_kind").rlike("^(OBJECT|VOID)"), "meta is no object")
        .when(F.col("t") < before, "t goes back")
    )
    df = df.withColumn("fault", fault)
    frames = df.where(F.col("fault").isNull() & ~F.col("torn")).select("line", "t", "data", F.to_json("meta").alias("meta"))
    return frames, df.where(F.col("fault").isNotNull()).select("line", "fault")


def duration(frames: DataFrame) -> DataFrame:
    """One row: the offset of the last frame, 0 for an empty tape."""
    return frames.agg(F.coalesce(F.max("t"), F.lit(0.0)).alias("duration_s"))


def tape_lines(frames: DataFrame) -> DataFrame:
    """Frames as lines of a tape, in order of time."""
    return frames.orderBy("t").select(F.to_json(F.struct(F.round("t", 6).alias("t"), F.lower(F.hex("data")).alias("data"), F.from_json("meta", "map<string,string>").alias("meta"))).alias("value"))


class Recorder:
    """Writes frames to a tape as they come, each line flushed."""

    def __init__(self, path: str, clock: Callable[[], float] = time.monotonic):
        self.file, self.clock, self.start = open(path, "a", encoding="utf-8"), clock, clock()

    def __call__(self, data: bytes, meta: dict | None = None) -> None:
        line = {"t": round(self.clock() - self.start, 6), "data": data.hex()} | ({"meta": meta} if meta else {})
        self.file.write(json.dumps(line, separators=(",", ":")) + "\n")
        self.file.flush()

    def close(self) -> None:
        self.file.close()
