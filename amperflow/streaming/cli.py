"""Command line: sources, discover, collect, import. Exit codes: 0 done, 1 failed, 2 wrong use."""

from __future__ import annotations

import argparse
import contextlib
import inspect
import json
import logging
import signal
import sys
import threading
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.redact import Scrubber, secret_name
from ..operators.ledger import Ledger
from ..scratch import scratch
from ..sinks.feed import write_feed
from ..sinks.feed_stream import FeedStream, stream_feed
from ..sources import discovery, registry
from . import collect as looping
from . import config as settings

log = logging.getLogger(__name__)
#: What keeps the state of streams. Spark's name.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="amperflow", description=__doc__)
    sub = p.add_subparsers(dest="verb", required=True)
    sub.add_parser("sources", help="known sources and their options")
    d = sub.add_parser("discover", help="what sources could read under a folder")
    d.add_argument("--json", action="store_true")
    d.add_argument("--source")
    d.add_argument("--path", default=".")
    d.add_argument("--opt", action="append", default=[], metavar="KEY=VALUE")
    for verb in ("collect", "import"):
        c = sub.add_parser(verb)
        c.add_argument("--config")
        c.add_argument("--source")
        c.add_argument("--opt", action="append", default=[], metavar="KEY=VALUE")
        c.add_argument("--institution")
        c.add_argument("--interval", help="seconds from one sample, or look at the folder, to the next")
        if verb == "collect":
            c.add_argument("--out")
            c.add_argument("--duration", help="seconds; without it until interrupted")
            c.add_argument("--cell", help="what the files are named after")
        else:
            c.add_argument("--out", "--out-dir", dest="out")
            c.add_argument("--ledger")
            c.add_argument("--reset-ledger", action="store_true")
            c.add_argument("--watch", action=argparse.BooleanOptionalAction, default=None)
    return p


@contextlib.contextmanager
def interrupts() -> Iterator[threading.Event]:
    """An event that an interrupt or a request to end sets, so that files are finished."""
    event, before = threading.Event(), {}
    if threading.current_thread() is threading.main_thread():
        before = {s: signal.signal(s, lambda *_: event.set()) for s in (signal.SIGINT, signal.SIGTERM)}
    try:
        yield event
    finally:
        for s, handler in before.items():
            signal.signal(s, handler)


def collect(spark: SparkSession, make: Callable, plan: dict, options: dict, stop: Callable[[], bool], scrub: Scrubber) -> dict:
    """A source that can be a stream goes on for the duration; any other is one finite batch."""
    known = inspect.signature(make).parameters
    facts = {"source": plan["source"], "options": options, "requested_interval_second": plan["interval"], "requested_duration_second": plan["duration"]}
    facts = scrub(facts)
    finite = "stream" not in known or "polls" in options
    options = options | ({"interval": plan["interval"]} if "interval" in known else {}) | ({"stream": True} if not finite else {})

    def write(df: DataFrame) -> int:
        df = df.persist()
        try:
            untimed = F.col("test_time_second").isNull() if "test_time_second" in df.columns else F.lit(True)
            rows, late = df.agg(F.count("*"), F.count_if(untimed)).first()
            if late and "series_id" in df.columns:
                log.warning("%d routed samples have no time of their own; their source should give one", late)
            write_feed(df, plan["out"], plan["institution"], metadata=facts, cell=plan["cell"])
            return rows
        finally:
            df.unpersist()

    if finite:
        df = make(spark, **options)
        timed = "test_time_second" in df.columns or "series_id" in df.columns
        rows = write(df if timed else df.withColumn("test_time_second", F.col("_seq") * plan["interval"]))
        return {"source": plan["source"], "samples": rows}
    runs: list[FeedStream] = []

    def start(df: DataFrame, once: bool):
        runs.append(stream_feed(df, plan["out"], checkpoint, plan["institution"], metadata=facts, cell=plan["cell"], once=once))
        return runs[-1].query

    checkpoint = scratch(spark, "collect")
    stats = looping.collect_stream(make(spark, **options), start, plan["duration"], stop=stop)
    for run in runs[-1:]:
        run.finish()
    return {"source": plan["source"], "samples": stats.samples, "errors": stats.errors, "seconds": round(stats.duration_s, 1)}


def watch(spark: SparkSession, plan: dict, options: dict, stop: Callable[[], bool]) -> dict:
    """Imports what is new; with ``watch`` again and again."""
    total = {"files": 0, "samples": 0, "quarantined": 0}
    while True:
        for k, v in looping.import_flights(spark, options["path"], plan["out"], plan["ledger"], plan["institution"]).items():
            total[k] += v
        until = time.monotonic() + plan["interval"]
        while plan["watch"] and not stop() and time.monotonic() < until:
            time.sleep(min(0.2, plan["interval"]))
        if not plan["watch"] or stop():
            return total


def planned(args: argparse.Namespace) -> tuple[Callable, dict, dict]:
    """(maker of the source, settings, options): the command line wins over the file, the file over defaults."""
    file = settings.load_config(args.config) if args.config else {}
    table = file.get(args.verb, {})
    name, options = settings.source_options(file, args.source, settings.parse_options(args.opt))
    given = lambda key, default=None, *more: settings.first_given(getattr(args, key, None), *(table.get(k) for k in (key, *more)), default)
    plan = {"source": name, "out": given("out", "feed", "out_dir"), "institution": given("institution", "LOCAL"), "cell": given("cell"), "watch": bool(given("watch", False))}
    plan["interval"] = settings.positive(given("interval", 1.0 if args.verb == "collect" else 5.0), "interval")
    duration = given("duration")
    plan["duration"] = None if duration is None else settings.positive(duration, "duration")
    plan["ledger"] = getattr(args, "ledger", None) or f"{plan['out']}/.ledger"
    return registry.source(name), plan, options


def discover(args: argparse.Namespace) -> int:
    """Candidates of one source or of all, as lines to be used or as JSON. None found is no error."""
    try:
        options = settings.parse_options(args.opt)
        if options and args.source is None:
            raise ValueError("--opt needs --source")
        if args.source is not None:
            registry.source(args.source)
    except (KeyError, ValueError) as e:
        print(f"error: {e.args[0]}", file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("amperflow").getOrCreate()
    scrub = Scrubber(settings.secrets_of(options))
    try:
        if args.source is None:
            found, notes = discovery.sweep(spark, args.path)
        else:
            found, notes = discovery.candidates(spark, args.source, args.path, **options).withColumn("source", F.lit(args.source)), {}
        rows = [json.loads(r[0]) for r in found.orderBy("source", "value").select(F.to_json(F.struct(*found.columns))).toLocalIterator()]
    except Exception as e:  # noqa: BLE001 -- whatever a third party's scan raises
        print(f"error: {scrub.text(str(e))}", file=sys.stderr)
        return 2
    if args.json:
        listed: dict[str, list] = {}
        for r in rows:
            listed.setdefault(r.pop("source"), []).append(r)
        print(json.dumps({"candidates": listed, "notes": notes}))
        return 0
    for r in rows:
        print(f"{r['source']}: {r['value']} ({r['bytes']} bytes)" + (f"  -> collect --source {r['source']} --opt {r['option']}={r['value']}" if r["ready"] else "  not ready"))
    for name, note in sorted(notes.items()):
        print(f"{name}: {note}")
    if not rows and not notes:
        print("nothing found")
    return 0


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.verb == "sources":
        for name in sorted(registry.available_sources()):
            print(name, json.dumps({k: "***" if v is not None and secret_name(k) else v for k, v in registry.options(name).items()}, default=str))
        return 0
    if args.verb == "discover":
        return discover(args)
    try:
        make, plan, options = planned(args)
    except (settings.ConfigError, KeyError, ValueError, TypeError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    unset = [o for o in registry.options(plan["source"]) if o not in options]
    scrub = Scrubber(settings.secrets_of(options) + settings.environment_secrets(unset))
    with settings.scrubbed_logs(scrub) as take_in, interrupts() as stop:
        try:
            spark = SparkSession.builder.appName("amperflow").config("spark.sql.streaming.stateStore.providerClass", STATE_STORE).getOrCreate()
            take_in()
            if args.verb == "import":
                if args.reset_ledger:
                    Ledger(spark, plan["ledger"]).reset()
                done = watch(spark, plan, options, stop.is_set)
            else:
                done = collect(spark, make, plan, options, stop.is_set, scrub)
            print(json.dumps(done))
            return 0
        except (ValueError, TypeError) as e:
            print(f"error: {scrub.text(str(e))}", file=sys.stderr)
            return 2
        except Exception as e:  # noqa: BLE001 -- the exit code tells
            print(f"failed: {scrub.text(str(e))}", file=sys.stderr)
            return 1


if __name__ == "__main__":
    sys.exit(main())
