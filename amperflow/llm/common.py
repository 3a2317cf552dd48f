"""Helpers shared by the training-data operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..scratch import scratch, shared


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clear_written(spark: SparkSession) -> None:
    """Delete all tables that this application wrote with :func:`written`.

    Operators drop what they have read to the end; what a lazy result still reads stays until this
    is called, once results are stored.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(shared(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: the lineage ends here."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Delete the folder of a table made by :func:`written` that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def byte_slices(column: pa.Array, most: int):
    """Yield (first row, end row, bytes, offsets) of a string column, nulls as empty texts.

    A slice holds about ``most`` bytes, or one longer text. Offsets start at 0 and have one
    entry more than the slice has rows.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    n = len(column)
    if n == 0:
        return
    _, at, data = column.buffers()
    ends = np.frombuffer(at, np.int64, n + 1, column.offset * 8)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    if column.null_count:
        # A null may still own bytes: give it a length of zero.
        sizes = np.where(np.asarray(column.is_valid()), np.diff(ends), 0)
        if int(sizes.sum()) != int(ends[-1] - ends[0]):
            yield from byte_slices(column.fill_null(b""), most)
            return
    first = 0
    while first < n:
        end = int(np.searchsorted(ends, ends[first] + most, side="right")) - 1
        end = min(n, max(end, first + 1))
        yield first, end, whole[ends[first] : ends[end]], ends[first : end + 1] - ends[first]
        first = end
