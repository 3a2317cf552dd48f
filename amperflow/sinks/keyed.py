"""A keyed table in a folder: rows merged by key into hash buckets, under a snapshot that is replaced in one step.

A merge reads and rewrites only the buckets that its rows fall into; other buckets are taken over by
name. A snapshot lists the files of each bucket, and one small pointer names the snapshot. Whatever
a merge wrote before the pointer moved is not there, and goes with the next merge. Reading costs the
live rows, however many merges there were. One writer at a time.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import stored

BUCKETS = 16


class KeyedTable:
    """Rows of ``schema``, one for each ``key`` that is not null: the one with the largest ``newest``, of equal ones the largest row."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, key: str, newest: str, buckets: int = BUCKETS):
        self.spark, self.folder, self.schema, self.key, self.newest, self.buckets = spark, folder.rstrip("/"), schema, key, newest, buckets
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.conf = spark._jsc.hadoopConfiguration()
        self.fs = self.path(self.folder).getFileSystem(self.conf)

    def _text(self, name: str) -> str | None:
        at = self.path(f"{self.folder}/{name}")
        if not self.fs.exists(at):
            return None
        stream = self.fs.open(at)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _put(self, name: str, content: str) -> None:
        """Write a small file beside its place, then move it there over what there was."""
        made = self.path(f"{self.folder}/{name}-{uuid.uuid4().hex}.tmp")
        out = self.fs.create(made, True)
        out.write(bytearray(content.encode()))
        out.close()
        files = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
        rename = self.spark._jvm.org.apache.hadoop.fs.Options.Rename
        over = self.spark.sparkContext._gateway.new_array(rename, 1)
        over[0] = rename.OVERWRITE
        files.rename(made, self.path(f"{self.folder}/{name}"), over)

    def snapshot(self) -> dict:
        """The current snapshot: its name, the one before it, and each bucket's folder."""
        name = self._text("CURRENT")
        if name is None:
            return {"name": None, "before": None, "buckets": {}}
        return json.loads(self._text(f"snapshot-{name.strip()}.json"))

    def rows(self, buckets: list[int] | None = None) -> DataFrame:
        """The live rows, of all buckets or some."""
        held = self.snapshot()["buckets"]
        paths = [f"{self.folder}/{p}" for b, p in held.items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def merge(self, rows: DataFrame) -> None:
        """Put rows in: new keys are added, newer rows replace older ones. No rows change nothing."""
        names = [f.name for f in self.spark.createDataFrame([], self.schema).schema.fields]
        number = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        rows = stored(rows.where(F.col(self.key).isNotNull()).select(*names), "keyed-rows")
        touched = sorted(r.b for r in rows.select(number.alias("b")).distinct().collect())  # at most as many as there are buckets
        if not touched:
            return
        whole = F.struct(self.newest, *(n for n in names if n not in (self.key, self.newest)))
        merged = self.rows(touched).unionByName(rows).groupBy(self.key).agg(F.max(whole).alias("row"))
        merged = merged.select(*(F.col(n) if n == self.key else F.col(f"row.{n}").alias(n) for n in names), number.alias("bucket"))
        now, made = self.snapshot(), uuid.uuid4().hex
        merged.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.folder}/data-{made}")
        held = now["buckets"] | {str(b): f"data-{made}/bucket={b}" for b in touched}
        self._swap({"name": made, "before": now["name"], "buckets": held})

    def clear(self) -> None:
        self._swap({"name": uuid.uuid4().hex, "before": self.snapshot()["name"], "buckets": {}})

    def _swap(self, snapshot: dict) -> None:
        self._put(f"snapshot-{snapshot['name']}.json", json.dumps(snapshot))
        self._put("CURRENT", snapshot["name"])
        self._sweep(snapshot)

    def _sweep(self, now: dict) -> None:
        """Take away what neither this snapshot nor the one before it (which may still be read) names."""
        before = self._text(f"snapshot-{now['before']}.json") if now["before"] else None
        kept = {f"snapshot-{n}.json" for n in (now["name"], now["before"])} | {"CURRENT"}
        paths = {p for s in (now, json.loads(before) if before else {"buckets": {}}) for p in s["buckets"].values()}
        kept |= {p.split("/")[0] for p in paths}
        for entry in self.fs.listStatus(self.path(self.folder)):
            name = entry.getPath().getName()
            if name.startswith(("snapshot-", "data-", "CURRENT-")) and name not in kept:
                self.fs.delete(entry.getPath(), True)
            elif name.startswith("data-"):
                for part in self.fs.listStatus(entry.getPath()):
                    bucket = part.getPath().getName()
                    if bucket.startswith("bucket=") and f"{name}/{bucket}" not in paths:
                        self.fs.delete(part.getPath(), True)
