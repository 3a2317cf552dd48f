"""Statistics of runs and buffers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import ARRIVAL


def run_stats(df: DataFrame) -> DataFrame:
    """One row: samples, non-empty batches, and the sorted names of columns that hold a value."""
    names = [c for c in df.columns if c not in ARRIVAL]
    some = F.array_compact(F.array(*(F.when(F.count(F.col(f"`{c}`")) > 0, F.lit(c)) for c in names)))
    batches = F.count_distinct("_batch_id") if "_batch_id" in df.columns else F.lit(1).cast("long")
    return df.agg(F.count("*").alias("samples"), batches.alias("batches"), F.array_sort(some).alias("columns"))


def newest(df: DataFrame, n: int, order: str = "_seq", *keys: str) -> DataFrame:
    """The newest ``n`` rows of each key: what a bounded buffer still holds."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
    return df.withColumn("__n", rank).where(F.col("__n") <= n).drop("__n")


def buffer_stats(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """Per key: rows received, and dropped from a buffer of ``n``."""
    total = F.count("*")
    return df.groupBy(*keys).agg(total.alias("received_total"), F.greatest(total - n, F.lit(0)).cast("long").alias("dropped_total"))


def strongest(df: DataFrame, n: int | None = None, rssi: str = "rssi", tie: str = "address") -> DataFrame:
    """By signal strength, strongest first, unknown last."""
    out = df.orderBy(F.desc_nulls_last(rssi), tie)
    return out.limit(n) if n else out


def monotonic_breaks(df: DataFrame, t: str = "t", order: str = "line", *keys: str) -> DataFrame:
    """Rows whose time lies before the row above."""
    before = F.lag(t).over(Window.partitionBy(*keys).orderBy(order))
    return df.withColumn("before", before).where(F.col(t) < F.col("before"))


def lifetime(df: DataFrame, *keys: str) -> DataFrame:
    """Per source: samples collected, the last batch that had any, and how many had."""
    return df.groupBy(*keys).agg(F.count("*").alias("samples_collected"), F.max("_batch_id").alias("last_batch"), F.count_distinct("_batch_id").alias("polls"))
