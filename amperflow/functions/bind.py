"""Values that are computed once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value as a lambda's variable: however often ``f`` uses it, it is computed once a row."""
    return F.get(F.transform(F.array(value), f), 0)
