"""What a source could read: candidates under a folder, each with the option that takes it.

A source takes part if its maker has ``discover(spark, path, **options)``, which gives rows of
(option, value, bytes, modified, ready). Built-in ones list captures by the names of their files.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import registry

SCHEMA = "option string, value string, bytes long, modified timestamp, ready boolean"


def captures(option: str, *suffixes: str) -> Callable[[SparkSession, str], DataFrame]:
    """A ``discover`` that lists files by suffix, those in folders below included.

    Only the listing is read, no content. Empty files hold nothing to read and are no candidates.
    """
    names = "*{" + ",".join(suffixes) + "}"

    def discover(spark: SparkSession, path: str) -> DataFrame:
        files = spark.read.format("binaryFile").option("pathGlobFilter", names).option("recursiveFileLookup", "true").load(path)
        return files.select(F.lit(option).alias("option"), F.col("path").alias("value"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"), F.lit(True).alias("ready"))

    return discover


class NoDiscovery(ValueError):
    """The named source cannot list candidates."""


def candidates(spark: SparkSession, name: str, path: str, **options) -> DataFrame:
    """Candidates of one source. Its availability is not asked: options may supply what it lacks."""
    hook = getattr(registry.source(name), "discover", None)
    if not callable(hook):
        raise NoDiscovery(f"source {name!r} does not support discovery")
    found = hook(spark, path, **options)
    return found if isinstance(found, DataFrame) else spark.createDataFrame(list(found), SCHEMA)


def sweep(spark: SparkSession, path: str, names: Iterable[str] | None = None) -> tuple[DataFrame, dict[str, str]]:
    """(candidates of all sources with their source's name, notes): what cannot run or fails is told and stops no other.

    Sources without ``discover`` are passed over. No candidate at all is an empty table.
    """
    out, notes = spark.createDataFrame([], f"source string, {SCHEMA}"), {}
    for name in sorted(registry.available_sources()) if names is None else names:
        if not callable(getattr(registry.source(name), "discover", None)):
            continue
        if reason := registry.availability(name):
            notes[name] = f"skipped: {reason}"
            continue
        try:
            out = out.unionByName(candidates(spark, name, path).select(F.lit(name).alias("source"), "option", "value", "bytes", "modified", "ready"))
        except Exception as e:  # noqa: BLE001 -- whatever a third party's scan raises
            notes[name] = f"failed: {e}"
    return out, notes
