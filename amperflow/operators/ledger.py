"""Which files were imported or set aside: two keyed tables in a folder, by content hash."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import content_hash
from ..scratch import stored
from ..sinks.keyed import KeyedTable

VERSION = 2
INGESTED = "content_hash string, path string, recorded_at timestamp, length long, modified timestamp"
QUARANTINED = "content_hash string, path string, reason string, quarantined_at timestamp"


class Ledger:
    """Two keyed tables; the newest entry of a hash counts, and the live entries are all that is read. Single writer."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/ledger.json")
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.exists(path):
            head = spark.read.text(path.toString(), wholetext=True).first()[0]
            try:
                version = json.loads(head)["version"]
            except (ValueError, KeyError, TypeError) as e:
                raise ValueError(f"the ledger in {folder} is corrupt") from e
            if version != VERSION:
                raise ValueError(f"the ledger in {folder} has version {version!r}, not {VERSION}")
        else:
            out = fs.create(path, False)
            out.writeBytes(json.dumps({"version": VERSION}))
            out.close()
        self._ingested = KeyedTable(spark, f"{self.folder}/ingested", INGESTED, "content_hash", "recorded_at")
        self._quarantined = KeyedTable(spark, f"{self.folder}/quarantined", QUARANTINED, "content_hash", "quarantined_at")

    @property
    def ingested(self) -> DataFrame:
        return self._ingested.rows().select("content_hash", "path", "recorded_at")

    @property
    def quarantined(self) -> DataFrame:
        return self._quarantined.rows().select("content_hash", "path", "reason", "quarantined_at")

    def new(self, files: DataFrame) -> DataFrame:
        """Files that are neither imported nor set aside; empty ones (null hash) always are new."""
        return files.join(self.ingested.select("content_hash"), "content_hash", "left_anti").join(self.quarantined.select("content_hash"), "content_hash", "left_anti")

    def unseen(self, listing: DataFrame) -> DataFrame:
        """Files of a listing (path, length, modified) that no entry names with the same size and time: only those need to be read."""
        known = self._ingested.rows().select("path", "length", "modified").where("modified is not null").distinct()
        return listing.join(known, ["path", "length", "modified"], "left_anti")

    def record(self, files: DataFrame) -> None:
        """Call after the files' rows are written: a crash in between imports them again."""
        seen = [F.col(c) if c in files.columns else F.lit(None).cast(kind).alias(c) for c, kind in (("length", "long"), ("modified", "timestamp"))]
        self._ingested.merge(files.select("content_hash", "path", F.current_timestamp().alias("recorded_at"), *seen))

    def quarantine(self, files: DataFrame) -> int:
        """Set files (content_hash, path, reason) aside; the same reason again changes nothing. Returns how many entries changed."""
        known = self.quarantined.select("content_hash", F.col("reason").alias("__was"))
        changed = files.where("content_hash is not null").join(known, "content_hash", "left").where(~F.col("reason").eqNullSafe(F.col("__was")))
        changed = stored(changed.select("content_hash", "path", "reason", F.current_timestamp().alias("quarantined_at")), "ledger-changed")
        self._quarantined.merge(changed)
        return changed.count()

    def reset(self) -> None:
        self._ingested.clear()
        self._quarantined.clear()


def candidates(spark: SparkSession, folder: str, ledger: Ledger | None = None) -> DataFrame:
    """path, length, modified, content_hash, content of the folder's flight logs (.txt and .dat in any case).

    With a ledger, files that it has with the same size and time are listed and not read.
    """
    named = lambda df: df.where(F.lower("path").rlike(r"\.(txt|dat)$"))
    files = spark.read.format("binaryFile")
    if ledger:
        left = ledger.unseen(named(files.load(folder)).select("path", "length", F.col("modificationTime").alias("modified")))
        paths = [r.path for r in left.select("path").collect()]  # a listing, as the driver holds it anyway
        if not paths:
            return spark.createDataFrame([], "path string, length long, modified timestamp, content_hash string, content binary")
        found = files.load(paths)
    else:
        found = named(files.load(folder))
    return found.select("path", "length", F.col("modificationTime").alias("modified"), content_hash(F.col("content")).alias("content_hash"), "content")
