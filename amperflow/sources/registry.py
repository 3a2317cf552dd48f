"""Known sources by name: built-in ones first, then those that installed packages offer."""

from __future__ import annotations

import importlib
import inspect
import logging
from collections.abc import Callable
from importlib.metadata import entry_points

log = logging.getLogger(__name__)
GROUP = "amperflow.sources"
#: Names and where their makers are: functions of a session and options that give samples.
BUILT_IN = {
    "simulator": "amperflow.sources.catalog:simulator",
    "csvtail": "amperflow.sources.catalog:csvtail",
    "charger": "amperflow.sources.catalog:charger",
    "flightlog": "amperflow.sources.catalog:flightlog",
    "phone": "amperflow.sources.catalog:phone",
    "packs": "amperflow.sources.catalog:packs",
}
#: Sinks: functions of a DataFrame, a target and options.
SINK_GROUP = "amperflow.sinks"
BUILT_IN_SINKS = {"feed": "amperflow.sinks.feed:write_feed", "push": "amperflow.sinks.push:push_rows", "parquet": "amperflow.sinks.parquet:write_frame"}


def _load(target: str) -> Callable:
    module, _, name = target.partition(":")
    return getattr(importlib.import_module(module), name)


def _available(built_in: dict[str, str], group: str) -> dict[str, Callable]:
    found = {}
    for name, target in [*built_in.items(), *((e.name, e) for e in entry_points(group=group) if e.name not in built_in)]:
        try:
            found[name] = _load(target) if isinstance(target, str) else target.load()
        except Exception as e:  # noqa: BLE001 -- whatever a third party's module raises
            log.warning("%s %s cannot be loaded: %s", group, name, e)
    return found


def _named(known: dict[str, Callable], name: str, what: str) -> Callable:
    if name not in known:
        raise KeyError(f"no {what} {name!r}; there are {', '.join(sorted(known))}")
    return known[name]


def available_sources() -> dict[str, Callable]:
    """All sources that load; a broken one is skipped with a warning, and never hides a built-in."""
    return _available(BUILT_IN, GROUP)


def source(name: str) -> Callable:
    return _named(available_sources(), name, "source")


def available_sinks() -> dict[str, Callable]:
    """All sinks that load, under the same rules."""
    return _available(BUILT_IN_SINKS, SINK_GROUP)


def sink(name: str) -> Callable:
    return _named(available_sinks(), name, "sink")


def options(name: str) -> dict[str, object]:
    """A source's options and their defaults (no default: required)."""
    return {p.name: None if p.default is p.empty else p.default for p in list(inspect.signature(source(name)).parameters.values())[1:]}


def availability(name: str) -> str | None:
    """Why a source cannot run here; None where it can. Live devices are out of scope: captures are read."""
    return getattr(source(name), "unavailable", lambda: None)()
