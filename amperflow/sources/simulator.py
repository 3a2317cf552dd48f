"""A simulated cell as a table, a batch source and a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.units import simulated_sample


def simulated(spark: SparkSession, polls: int, **cell) -> DataFrame:
    """One sample per poll: _seq and the cell's columns."""
    df = spark.range(polls).withColumnRenamed("id", "_seq")
    return df.select("_seq", *simulated_sample(F.col("_seq"), **cell))


def simulated_stream(spark: SparkSession, per_batch: int = 1, **cell) -> DataFrame:
    """The same without end: every micro-batch is so many polls."""
    df = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", per_batch).load()
    return df.select(F.col("value").alias("_seq"), *simulated_sample(F.col("value"), **cell))
