"""Does a third party's source keep the rules? All faults are told at once.

Looked at are sources that are polled (objects with ``name``, ``poll()``, ``metadata()`` and ``close()``)
and makers of DataFrames (functions of a session and options). Not looked at: whether samples are
true, what happens under load, and what a device does when it is unplugged.
"""

from __future__ import annotations

import inspect
import json
import math
from collections.abc import Callable, Iterator, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from .operators import contract
from .schema import RESERVED

TIME = "test_time_second"


def sample_faults(sample: Any) -> Iterator[str]:
    """What is wrong with one sample of a polled source."""
    if not isinstance(sample, dict):
        yield f"a sample is a dict, not {type(sample).__name__}"
        return
    for key, value in sample.items():
        if not isinstance(key, str):
            yield f"key {key!r} is not text"
        if isinstance(value, bool) or not isinstance(value, (int, float, str, type(None))):
            yield f"{key}: {type(value).__name__} is neither number nor text"
        elif isinstance(value, float) and not math.isfinite(value):
            yield f"{key} is not finite"
    routed = [k for k in RESERVED if sample.get(k) is not None]
    yield from (f"{k} is not text" for k in routed if not isinstance(sample[k], str))
    time = sample.get(TIME)
    if routed and time is None:
        yield f"a routed sample has {TIME}"
    if time is not None and (isinstance(time, (bool, str)) or time < 0):
        yield f"{TIME} is a number from 0 on, not {time!r}"


def metadata_faults(metadata: Any) -> Iterator[str]:
    if not isinstance(metadata, Mapping):
        yield f"metadata is a mapping, not {type(metadata).__name__}"
        return
    yield from (f"metadata key {k!r} is not text" for k in metadata if not isinstance(k, str))
    try:
        json.dumps(metadata, allow_nan=False)
    except (TypeError, ValueError) as e:
        yield f"metadata is no JSON: {e}"


def polled_faults(source: Any, polls: int = 3) -> Iterator[str]:
    """What is wrong with a polled source, over some polls and two closes."""
    if polls < 1:
        raise ValueError("a source is polled once at least")
    name = getattr(source, "name", None)
    if not isinstance(name, str) or not name.strip():
        yield "a source has a name that is not blank"
    if callable(told := getattr(source, "availability", None)) and not isinstance(reason := told(), (str, type(None))):
        yield f"availability is a reason or None, not {reason!r}"
    seen: list[Any] = []  # kept, so that no identity is given twice
    try:
        for _ in range(polls):
            batch = source.poll()
            if not isinstance(batch, list):
                yield f"poll gives a list, not {type(batch).__name__}"
                break
            for sample in batch:
                yield from sample_faults(sample)
            if len({id(s) for s in [*seen, *batch]}) < len(seen) + len(batch):
                yield "a sample is handed out more than once"
            seen += batch
        if callable(getattr(source, "metadata", None)):
            yield from metadata_faults(source.metadata())
    finally:
        for _ in range(2):
            source.close()


def maker_faults(spark: SparkSession, make: Callable[..., DataFrame], **options) -> Iterator[str]:
    """What is wrong with a maker of DataFrames."""
    if not list(inspect.signature(make).parameters):
        yield "a maker takes the session first"
        return
    df, again = make(spark, **options), make(spark, **options)
    if not isinstance(df, DataFrame):
        yield f"a maker gives a DataFrame, not {type(df).__name__}"
        return
    if df.schema != again.schema:
        yield "the columns change from call to call"
    if "_seq" not in df.columns:
        yield "samples have _seq, their order"
    yield from (f"{r.rule}: {r.rows} rows" for r in contract.violations(df.drop("_seq", "_batch_id")).collect())


def check(faults: Iterator[str]) -> None:
    """Raises with all faults, each told once."""
    found = list(dict.fromkeys(faults))
    if found:
        raise AssertionError("; ".join(found))
