"""Samples as Parquet under the union of all columns; rows are rescued as JSON lines where that fails."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.redact import redact_metadata
from ..operators.contract import union_ragged


def put_text(spark: SparkSession, path: str, content: str) -> None:
    """A small file by way of Spark's file systems."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(content.encode()))
    out.close()


def conflicts(frames: list[DataFrame]) -> dict[str, set[str]]:
    """Columns that have more than one type."""
    kinds: dict[str, set[str]] = {}
    for f in frames:
        for name, kind in f.dtypes:
            kinds.setdefault(name, set()).add(kind)
    return {n: k for n, k in kinds.items() if len(k) > 1}


def write_parquet(frames: list[DataFrame], path: str, metadata: dict | None = None) -> bool:
    """All rows of all frames, routing columns kept; True where it is Parquet, False where rows had to be rescued.

    Rows that fit no one schema, or that Parquet refuses, are rescued as JSON lines under a name that
    nothing has yet. A target that exists already is an error and no reason for a rescue.
    """
    spark = frames[0].sparkSession
    facts = {"metadata": redact_metadata(metadata or {}), "columns": list(dict.fromkeys(c for f in frames for c in f.columns))}
    mixed, why = conflicts(frames), None
    if mixed:
        why = f"columns of several types: {', '.join(sorted(mixed))}"
    else:
        try:
            union_ragged(*frames).write.mode("errorifexists").parquet(path)
        except AnalysisException as e:
            if e.getCondition() == "PATH_ALREADY_EXISTS":
                raise
            why = str(e)[:500]
        except Exception as e:  # noqa: BLE001 -- rows must not be lost, whatever stopped the write
            why = str(e)[:500]
    if why is None:
        put_text(spark, f"{path}.meta.json", json.dumps(facts | {"finalized": True}))
        return True
    lines = union_ragged(*(f.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")) for f in frames))
    lines.write.mode("errorifexists").text(unused(spark, f"{path}.rescue.ndjson"))
    put_text(spark, f"{path}.meta.json", json.dumps(facts | {"finalized": False, "error": why}))
    return False


def write_frame(df: DataFrame, path: str, metadata: dict | None = None) -> bool:
    """One frame, as :func:`write_parquet` writes several."""
    return write_parquet([df], path, metadata)


def unused(spark: SparkSession, path: str) -> str:
    """The path, or the first with a number that nothing is at."""
    for n in range(1000):
        found = f"{path}-{n}" if n else path
        p = spark._jvm.org.apache.hadoop.fs.Path(found)
        if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
            return found
    raise FileExistsError(path)
