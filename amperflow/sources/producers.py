"""Row producers as table functions: one file in, its samples out, or why there are none.

A producer is a function of a file's name and bytes that yields rows as mappings. It becomes a Python
table function whose columns follow from its second argument when a query is analysed, and which is
joined laterally to a listing of files: files are shared out among tasks, and a file's rows are
handed on as they come. A file that the producer refuses gives one row with the reason instead.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, DateType, DoubleType, IntegerType, LongType, StringType, StructType, TimestampType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

REASON, NUMBER = "_reason", "_seq"
SIMPLE = {"boolean": BooleanType, "int": IntegerType, "long": LongType, "bigint": LongType, "double": DoubleType, "string": StringType, "binary": BinaryType, "timestamp": TimestampType, "date": DateType}
Producer = Callable[[str, bytes], Iterator[Mapping[str, Any]]]


class Refused(ValueError):
    """Raised by a producer for a file that it cannot read; the text is the reason."""


def _columns(wanted: str) -> StructType:
    """The columns of ``name type, ...`` with simple types, or of a schema's JSON. Workers have no session, so Spark's own parser is not there."""
    if wanted.lstrip().startswith("{"):
        found = StructType.fromJson(json.loads(wanted))
    else:
        found = StructType()
        for part in wanted.split(","):
            name, _, kind = part.strip().partition(" ")
            if kind.strip().lower() not in SIMPLE:
                raise ValueError(f"{part.strip()!r} is no column of a simple type: give the schema as JSON")
            found = found.add(name, SIMPLE[kind.strip().lower()]())
    if taken := {f.name for f in found} & {REASON, NUMBER}:
        raise ValueError(f"columns {sorted(taken)} are the function's own")
    return found


def table_function(produce: Producer):
    """A table function (name, content, columns as constant text) of a producer.

    Its rows have the columns, ``_seq`` (the row's number in the file) and ``_reason``. Keys that are
    no columns are left out, columns without a key are null. Rows that came before a file was refused
    are taken back: a file gives all of its rows or none, so a producer holds one file's rows at most.
    """

    class Produced:
        def __init__(self) -> None:
            self.names: list[str] | None = None

        @staticmethod
        def analyze(name: AnalyzeArgument, content: AnalyzeArgument, columns: AnalyzeArgument) -> AnalyzeResult:
            if not columns.isConstantExpression or columns.value is None:
                raise ValueError("the columns must be a constant text")
            return AnalyzeResult(_columns(columns.value).add(NUMBER, LongType()).add(REASON, StringType()))

        def eval(self, name: str, content: bytes, columns: str):
            if self.names is None:
                self.names = _columns(columns).names
            nothing = (None,) * len(self.names)
            if not content:
                yield (*nothing, None, "empty")
                return
            rows = []
            try:
                for k, row in enumerate(produce(name, bytes(content))):
                    rows.append((*(row.get(c) for c in self.names), k, None))
            except Refused as e:
                yield (*nothing, None, str(e) or "refused")
            except Exception as e:  # noqa: BLE001 -- one file that breaks a third party's code must not stop the others
                yield (*nothing, None, f"{type(e).__name__}: {e}")
            else:
                yield from rows if rows else [(*nothing, None, "no rows")]

    return F.udtf(Produced)


def produce(files: DataFrame, producer: Producer, columns: str, name: str = "path", content: str = "content") -> tuple[DataFrame, DataFrame]:
    """(samples, refused) of files (name, content and any other columns): samples with the files' other columns, refused files with ``_reason``.

    A null or empty file is refused as empty, one without rows as such. Files of one name are files of
    their own.
    """
    columns = StructType.fromDDL(columns).json()
    kept = [c for c in files.columns if c != content]
    clash = {c.lower() for c in kept} & {*(n.lower() for n in _columns(columns).names), NUMBER, REASON}
    if clash:
        raise ValueError(f"columns {sorted(clash)} are both the files' and the producer's")
    function = table_function(producer)
    rows = files.lateralJoin(function(F.col(name).cast("string").outer(), F.col(content).cast("binary").outer(), F.lit(columns)))
    samples = rows.where(F.col(REASON).isNull()).drop(content, REASON)
    return samples, rows.where(F.col(REASON).isNotNull()).select(*(F.col(f"`{c}`") for c in kept), REASON)
