"""Do feed files keep the format? A table of faults, file by file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import units
from ..schema import RESERVED, TRIO
from ..sources.catalog import cells

NAME = r"^[^_]+(?:_[^_]+)*__.+__[0-9]{8}_(?:[0-9]{3}|[1-9][0-9]{3,})\.bdf\.csv$"


def validate_feed(spark: SparkSession, folder: str) -> DataFrame:
    """(file, fault, rows) of the feed files in a folder; nothing where all keep the format.

    A file's name says institution, cell, day and number; its header begins with the trio, names no
    column twice and none that routes; every row has as many cells; numbers of the trio are finite,
    time is not negative; and its description, which must be final, counts as many rows.
    """
    at = F.struct("__block", "__id")
    lines = spark.read.text(f"{folder}/*.csv").select(F.substring_index(F.col("_metadata.file_path"), "/", -1).alias("file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__id"), "value")
    heads = lines.groupBy("file").agg(F.min_by("value", at).alias("head"), F.min(at).alias("first"), (F.count("*") - 1).alias("there"))
    heads = heads.withColumn("names", cells(F.col("head")))
    rows = lines.join(heads.select("file", "first", F.size("names").alias("wide")), "file").where(at > F.col("first")).withColumn("c", cells(F.col("value")))
    number = [units.strict_double(F.get("c", k)) for k in range(len(TRIO))]
    given = [F.length(F.coalesce(F.get("c", k), F.lit(""))) > 0 for k in range(len(TRIO))]
    checks = {"cells": F.size("c") != F.col("wide"), "time is negative": number[0] < 0} | {f"{n} is no number": given[k] & number[k].isNull() for k, n in enumerate(TRIO)}
    of_rows = rows.groupBy("file").agg(*(F.count_if(F.coalesce(c, F.lit(False))).alias(f"r{k}") for k, c in enumerate(checks.values())))
    of_rows = of_rows.select("file", F.explode(F.array(*(F.struct(F.lit(f).alias("fault"), F.col(f"r{k}").alias("rows")) for k, f in enumerate(checks)))).alias("x")).select("file", "x.*").where("rows > 0")
    told = spark.read.option("multiLine", True).schema("file string, rows long, finalized boolean").json(f"{folder}/*.meta.json")
    both = heads.join(told.select("file", F.col("rows").alias("told"), "finalized"), "file", "left")
    of_files = {
        "name": ~F.col("file").rlike(NAME), "header": F.slice("names", 1, len(TRIO)) != F.array(*(F.lit(n) for n in TRIO)), "repeated column": F.size(F.array_distinct("names")) != F.size("names"),
        "routing column": F.arrays_overlap("names", F.array(*(F.lit(n) for n in RESERVED))), "no description": F.col("told").isNull(), "not final": ~F.col("finalized"), "rows": F.col("told") != F.col("there"),
    }
    faults = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(f)) for f, c in of_files.items())))
    return both.select("file", F.explode(faults).alias("fault"), F.lit(0).cast("long").alias("rows")).union(of_rows.select("file", "fault", "rows"))
