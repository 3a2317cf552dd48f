"""The built-in sources: each takes a session and options and gives samples with ``_seq``."""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, units
from ..operators import align, gate, project
from . import charger as bays
from .csvtail import SPLIT, CsvTailSource, surveyed
from .discovery import captures
from .simulator import simulated


def simulator(spark: SparkSession, polls: int = 10, steps: int = 3600, stream: bool = False, interval: float = 1.0) -> DataFrame:
    """Samples of a simulated cell: ``polls`` of them, or a stream of one every ``interval`` seconds."""
    if not stream:
        return simulated(spark, polls, steps=steps)
    per_second = max(1, round(1 / interval))
    ticks = spark.readStream.format("rate").option("rowsPerSecond", per_second).load()
    every = max(1, round(interval * per_second))
    step = (F.col("value") / every).cast("long")
    return ticks.where(F.col("value") % every == 0).select(step.alias("_seq"), (step * interval).cast("double").alias("test_time_second"), *units.simulated_sample(step, steps))


def csvtail(spark: SparkSession, path: str, column_map: dict | str, unit_scale: dict | str | None = None, stream: bool = False, split: int = SPLIT, by_file: bool = False) -> DataFrame:
    """Records of CSV files (a file, a folder or a pattern), mapped and scaled; a stream goes on with what is appended and with files that come.

    Files are read in ranges of about ``split`` bytes. ``by_file`` makes each file a series of its own.
    """
    spark.dataSource.register(CsvTailSource)
    column_map, unit_scale = (json.loads(x) if isinstance(x, str) else x for x in (column_map, unit_scale))
    reader = (spark.readStream if stream else spark.read).format("csvtail").option("path", os.fspath(path)).option("columns", ",".join(column_map)).option("split", split)
    if not stream:
        reader = reader.option("surveyed", surveyed(spark, os.fspath(path), int(split)))
    df = reader.load().withColumn("series_id", F.regexp_replace(F.element_at(F.split("_file", "/"), -1), r"\.csv$", ""))
    return project.map_and_scale(df, column_map, unit_scale, keep=("_seq", "series_id") if by_file else ("_seq",))[0]


def charger(spark: SparkSession, polls: int = 10, slot: int | None = None, time_base: str = "collection") -> DataFrame:
    """Samples of a simulated charger's occupied bays, one series per bay."""
    df = bays.readings(bays.polled(spark, polls))[0]
    df = df if slot is None else df.where(F.col("slot") == slot)
    return df.select(F.format_string("bay-%d", "slot").alias("series_id"), "_seq", *project.charger_sample(F.col("reading"), time_base))


def flightlog(spark: SparkSession, path: str, include_gps: bool = False) -> DataFrame:
    """Samples of parsed flight logs (CSV files); each file is one run."""
    files = spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("content_hash"), readable("content").alias("csv"))
    return gate.normalize_flights(flight_lines(files.where("csv is not null")), include_gps)[0]


def readable(content: str) -> Column:
    """The bytes as text, null where they are no UTF-8: one such file must not stop the others."""
    c = F.col(content)
    return F.when(F.is_valid_utf8(c.cast("string")), c.cast("string"))


def flight_lines(files: DataFrame) -> DataFrame:
    """Rows of whole CSV files (content_hash, csv): their columns by name, _seq by line.

    Cells may be quoted and hold commas; a quote within a cell is written twice.
    """
    lines = files.select("content_hash", F.posexplode(F.split("csv", r"\r\n|\n")).alias("_seq", "line")).where(F.trim("line") != "")
    head = files.select("content_hash", cells(F.trim(F.substring_index(F.col("csv"), "\n", 1))).alias("head"))
    names = sorted({r[0] for r in head.select(F.explode("head")).distinct().collect()})  # as many columns as logs have
    rows = lines.where("_seq > 0").join(head, "content_hash").withColumn("cells", cells(F.col("line")))
    of = lambda n: F.get("cells", (F.array_position("head", F.lit(n)) - 1).cast("int"))
    return rows.select("content_hash", "_seq", *(F.when(F.array_contains("head", F.lit(n)), of(n)).alias(n) for n in names))


def cells(line: Column) -> Column:
    """The cells of a line of CSV."""
    raw = F.regexp_extract_all(line, F.lit(r'(?:^|,)("(?:[^"]|"")*+"|[^,]*+)'), F.lit(1))
    return F.transform(raw, lambda c: F.when(c.rlike('(?s)^".*"$'), F.replace(c.substr(F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c))


def phone(spark: SparkSession, path: str, include_soc: bool = False) -> DataFrame:
    """Samples of phone captures: JSON lines of {"dumpsys": text, "sysfs": {name: text}}."""
    df = spark.read.schema("dumpsys string, sysfs map<string,string>, _seq long").json(path)
    fields = text.key_values(F.coalesce("dumpsys", F.lit("")))
    return df.withColumn("__f", fields).select("_seq", *project.phone_sample(F.coalesce("sysfs", F.create_map().cast("map<string,string>")), F.col("__f"), include_soc))


def packs(spark: SparkSession, status: str, full: str, cycles: str) -> DataFrame:
    """Samples of captured battery classes (JSON lines with InstanceName and Tag), lined up by key."""

    def read(path: str, *fields: str) -> DataFrame:
        df = spark.read.schema("InstanceName string, Tag long, pos long, " + ", ".join(f"{f} double" for f in fields)).json(path)
        return df.withColumn("key", align.instance_key(F.col("InstanceName"), F.col("Tag")))

    s = read(status, "Voltage", "ChargeRate", "DischargeRate", "RemainingCapacity")
    s = align.align(s, read(full, "FullChargedCapacity"), ["FullChargedCapacity"])
    s = align.align(s, read(cycles, "CycleCount"), ["CycleCount"])
    fields = {"voltage_mv": F.col("Voltage"), "charge_mw": F.col("ChargeRate"), "discharge_mw": F.col("DischargeRate"), "remaining_mwh": F.col("RemainingCapacity")}
    return s.select("key", F.col("pos").alias("_seq"), *project.power_pack(fields, F.col("FullChargedCapacity"), F.col("CycleCount")))


csvtail.discover = captures("path", ".csv")
flightlog.discover = captures("path", ".csv")
phone.discover = captures("path", ".json", ".ndjson", ".jsonl")
