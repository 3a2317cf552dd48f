"""A folder for what a query writes and reads again."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where that setting is missing, a session of one machine (master ``local``) gets a temporary
    folder; any other raises, since its executors would write to their own disks.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="amperflow-")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/amperflow-{spark.sparkContext.applicationId}"


def scratch(spark: SparkSession, name: str) -> str:
    """A path in this application's part of the shared folder that nothing is at."""
    return f"{shared(spark)}/{name}-{uuid.uuid4().hex}"


def mounted(path: str) -> str:
    """The path as the operating system has it; raises for a store that is not mounted."""
    if re.match(r"[a-z][a-z0-9+.-]+:", path) and not path.startswith("file:"):
        raise ValueError(f"{path} is no mounted folder")
    return re.sub("^file:/*", "/", path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: the lineage ends here, and what it holds is what it stays."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt out by keys over four tasks a core and more, before what costs much for each row: Spark would not cut a file's groups of rows, nor keep small partitions apart."""
    spark = df.sparkSession
    return df.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)
