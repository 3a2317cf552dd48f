"""A Python data source that tails growing CSV files: each record is read once, records under way wait.

Files are read in byte ranges that begin and end where records do, quoted line ends included, by as
many tasks as there are ranges. Where records end depends on every quotation mark before, so that has
to be counted first: for a batch by Spark tasks over splits of the files (:func:`surveyed`), for a
stream by the driver over the bytes that have come since, which it only counts and does not keep.
"""

from __future__ import annotations

import csv
import glob
import io
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

QUOTE, LF = 34, 10
#: Bytes that a range has at least before it is cut, and bytes looked at together.
SPLIT, BLOCK = 32 << 20, 8 << 20


def listed(path: str) -> list[str]:
    """The files of a path: itself, a folder's ``.csv`` files, or what a pattern matches, by name."""
    if os.path.isdir(path):
        path = os.path.join(glob.escape(path), "*.csv")
    return sorted(glob.glob(path)) if glob.has_magic(path) else [path] if os.path.exists(path) else []


def record_ends(data: np.ndarray, inside: int) -> tuple[np.ndarray, int]:
    """(places behind each record's line end, whether a quotation is open at the end); ``inside`` is 1 where one is open at the start."""
    quoted = (np.cumsum(data == QUOTE) + inside) & 1
    return np.flatnonzero((data == LF) & (quoted == 0)) + 1, int(quoted[-1]) if len(data) else inside


def blocks(path: str, start: int, end: int, inside: int = 0) -> Iterator[tuple[np.ndarray, int]]:
    """(places behind records, as the file counts bytes; whether a quotation is open) for each block of a file's bytes."""
    with open(path, "rb") as f:
        f.seek(start)
        while start < end and (data := f.read(min(BLOCK, end - start))):
            ends, inside = record_ends(np.frombuffer(data, np.uint8), inside)
            yield ends + start, inside
            start += len(data)


class Scan:
    """What is known of a file up to a place behind a record: ``byte``, the number of the next record (the header is -1), and the header."""

    def __init__(self, path: str, byte: int = 0, seq: int = -1, header: str = ""):
        self.path, self.byte, self.seq, self.header = path, byte, seq, header

    def told(self) -> dict:
        return {"byte": self.byte, "seq": self.seq, "header": self.header}

    def on(self, until: int, split: int | None = None) -> list[dict]:
        """Go on to the last record that ends by ``until``; returns the places where ranges may begin: behind the header, and with ``split`` each so many bytes."""
        cuts: list[dict] = []
        for ends, _ in blocks(self.path, self.byte, until):
            for k, end in enumerate(ends.tolist() if split or not self.header else []):
                if not self.header:
                    with open(self.path, "rb") as f:
                        began = self.byte if k == 0 else int(ends[k - 1])
                        f.seek(began)
                        self.header = f.read(end - began).decode("utf-8-sig", "replace").strip("\r\n")
                    if self.header:
                        cuts.append({"byte": end, "seq": self.seq + k + 1, "header": self.header})
                elif split and end - (cuts[-1]["byte"] if cuts else self.byte) >= split:
                    cuts.append({"byte": end, "seq": self.seq + k + 1, "header": self.header})
                elif not split:
                    break
            if len(ends):
                self.byte, self.seq = int(ends[-1]), self.seq + len(ends)
        return cuts


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int
    seq: int
    header: str


def ranges(path: str, start: dict, end: dict, split: int) -> list[Range]:
    """The byte ranges of a file between two of its places."""
    places = [start]
    if not start["header"] or end["byte"] - start["byte"] > split:
        places += Scan(path, start["byte"], start["seq"], start["header"]).on(end["byte"], split)
    places = [p for p in places if p["header"] and p["byte"] < end["byte"]]
    return [Range(path, p["byte"], q["byte"], p["seq"], p["header"]) for p, q in zip(places, [*places[1:], end], strict=True)] if places else []


def records(wanted: list[str], part: Range, encoding: str) -> Iterator[tuple]:
    """The records of a range that are not empty, as texts, with their numbers and the file's name."""
    with open(part.path, "rb") as f:
        f.seek(part.start)
        data = f.read(part.end - part.start)
    cells = lambda text: [c for r in csv.reader(io.StringIO(text, newline="")) for c in r]
    place = {h: k for k, h in enumerate(cells(part.header))}
    at = [place.get(w) for w in wanted]
    start = 0
    for k, end in enumerate(record_ends(np.frombuffer(data, np.uint8), 0)[0].tolist()):
        record = cells(data[start:end].decode(encoding, "replace").rstrip("\r\n"))
        start = end
        if any(c.strip() for c in record):
            yield (*(record[k] if k is not None and k < len(record) else None for k in at), part.seq + k, part.path)


class CsvTailSource(DataSource):
    """``format("csvtail")``: options path (a file, folder or pattern), columns (comma-separated header names), encoding, split (bytes).

    All columns are text, plus ``_seq``, the record's number in its file, and ``_file``. Encodings must
    keep ASCII bytes as they are. Files must be readable by driver and executors.
    """

    @classmethod
    def name(cls) -> str:
        return "csvtail"

    def schema(self) -> str:
        names = [c.strip() for c in self.options["columns"].split(",")]
        return ", ".join([*(f"`{c}` string" for c in names), "_seq bigint", "_file string"])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Batch(schema, self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802 -- Spark's name
        return _Tail(schema, self.options)


class _Reading:
    def __init__(self, schema: StructType, options):
        self.options = dict(options)
        self.wanted = [f.name for f in schema.fields if f.name not in ("_seq", "_file")]
        self.split = int(self.options.get("split", SPLIT))
        self.encoding = self.options.get("encoding", "utf-8")
        if '\n,"'.encode(self.encoding) != b'\n,"':
            raise ValueError(f"{self.encoding} does not keep ASCII bytes")

    def read(self, partition: Range | None) -> Iterator[tuple]:
        return iter(()) if partition is None else records(self.wanted, partition, self.encoding)  # Spark reads one None where there is no range


class _Batch(_Reading, DataSourceReader):
    def partitions(self) -> list[Range]:
        if "surveyed" in self.options:
            return [Range(**r) for r in json.loads(self.options["surveyed"])]
        found = []
        for path in listed(self.options["path"]):
            scan = Scan(path)
            scan.on(os.path.getsize(path))
            found += ranges(path, Scan(path).told(), scan.told(), self.split)
        return found


class _Tail(_Reading, DataSourceStreamReader):
    def __init__(self, schema: StructType, options):
        super().__init__(schema, options)
        self.seen: dict[str, Scan] = {}

    def initialOffset(self) -> dict:  # noqa: N802
        return {"files": {}}

    def latestOffset(self) -> dict:  # noqa: N802
        for path in listed(self.options["path"]):
            scan = self.seen.setdefault(path, Scan(path))
            scan.on(os.path.getsize(path))
        return {"files": {p: s.told() for p, s in sorted(self.seen.items())}}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        found = []
        for path, to in end["files"].items():
            since = start["files"].get(path) or Scan(path).told()
            # A stream that goes on from its checkpoint has counted up to there before.
            if path not in self.seen or self.seen[path].byte < to["byte"]:
                self.seen[path] = Scan(path, **to)
            found += ranges(path, since, to, self.split)
        return found


def _split_facts(splits: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each split of a file, and for either state it may begin in: the state it ends in, how many records end in it, and behind the first and the last of them."""
    for df in splits:
        out = []
        for path, number, start, end in df.itertuples(index=False):
            facts = {"path": path, "number": number}
            for inside in (0, 1):
                state, n, first, last = inside, 0, -1, -1
                for ends, after in blocks(path, start, end, inside):
                    state = after
                    if len(ends):
                        first, last, n = first if n else int(ends[0]), int(ends[-1]), n + len(ends)
                facts |= {f"open{inside}": state, f"n{inside}": n, f"first{inside}": first, f"last{inside}": last}
            out.append(facts)
        yield pd.DataFrame(out)


FACTS = "path string, number long, open0 int, n0 long, first0 long, last0 long, open1 int, n1 long, first1 long, last1 long"


def surveyed(spark: SparkSession, path: str, split: int = SPLIT) -> str:
    """The ranges of a batch, as an option of the source.

    Tasks look at splits of the files, for both states in which a split may begin; the driver gets
    one row a split and follows the states from each file's beginning.
    """
    sizes = {p: os.path.getsize(p) for p in listed(path)}
    splits = [(p, k, k * split, min((k + 1) * split, n)) for p, n in sizes.items() for k in range(-(-n // split))]
    if not splits:
        return "[]"
    df = spark.createDataFrame(splits, "path string, number long, start long, end long").repartition(min(len(splits), 10_000), "path", "number")
    facts = {(r.path, r.number): r for r in df.mapInPandas(_split_facts, FACTS).collect()}
    found: list[dict] = []
    for p, size in sizes.items():
        head, until = Scan(p), BLOCK
        while not (places := Scan(p).on(min(until, size))) and until < size:
            until *= 2  # a header longer than what was looked at
        if not places:
            continue
        head, places = places[0], places[:1]
        inside, seq, end = 0, -1, 0
        for k in range(-(-size // split)):
            state, n, first, last = (facts[p, k][f"{c}{inside}"] for c in ("open", "n", "first", "last"))
            if n and first > head["byte"]:
                places.append({"byte": first, "seq": seq + 1, "header": head["header"]})
            inside, seq, end = state, seq + n, last if n else end
        if not (places := [q for q in places if q["byte"] < end]):
            continue  # a header alone
        found += [Range(p, a["byte"], b["byte"], a["seq"], a["header"]).__dict__ for a, b in zip(places, [*places[1:], {"byte": end}], strict=True)]
    return json.dumps(found)
