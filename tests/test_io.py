"""Sources, sinks and streams."""

import gzip
import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from amperflow.functions.redact import Scrubber
from amperflow.operators import ledger
from amperflow.plans import proofs
from amperflow.sinks import feed, parquet, push, validate
from amperflow.sources import catalog, charger, registry, simulator, tape
from amperflow.streaming import buffer, cli, collect, config, segmenter, supervisor


def test_tail(spark, tmp_path):
    path = tmp_path / "log.csv"
    options = {"path": str(path), "column_map": {"Time/s": "test_time_second", "Ewe/mV": "voltage_volt"}, "unit_scale": {"Ewe/mV": 0.001}}
    path.write_text("Time/s,Ewe/mV,Ns\n0.0,3200,1\n1.0,ERR,1\n2.0,33")
    assert [r.voltage_volt for r in catalog.csvtail(spark, **options).collect()] == [3.2]
    got = []

    def run():
        q = collect.stream_to(catalog.csvtail(spark, **options, stream=True), lambda df, _: got.extend(df.orderBy("_seq").collect()), f"{tmp_path}/check", once=True)
        q.awaitTermination(60)

    run()
    assert [r.voltage_volt for r in got] == [3.2]
    with path.open("a") as f:
        f.write("00,1\n3.0,3400,1\n")
    run()
    assert [(r._seq, round(r.voltage_volt, 9)) for r in got] == [(0, 3.2), (2, 3.3), (3, 3.4)]


def test_simulator_and_registry(spark):
    rows = simulator.simulated(spark, 3).collect()
    assert rows[0].voltage_volt == 3.0 and rows[2].current_ampere == -0.002
    assert set(registry.BUILT_IN) <= set(registry.available_sources()) and "path" in registry.options("csvtail")
    with pytest.raises(KeyError, match="simulator"):
        registry.source("nothing")


def test_charger(spark):
    good, bad = charger.readings(charger.polled(spark, 50))
    assert bad.count() == 0 and sorted({r.slot for r in good.select("slot").distinct().collect()}) == [0, 1, 2]
    last = good.where("slot = 2").orderBy(F.desc("_seq")).first().reading
    assert last.elapsed_s == 50 and last.capacity_mah == 14
    assert {r.series_id: r.current_ampere for r in catalog.charger(spark, 1).collect()} == {"bay-0": 1.0, "bay-1": -0.5, "bay-2": 1.0}


def stepped(bay, n, seconds):
    """A bay, step by step: charge is counted, ends stop it, and cycle mode turns round."""
    soc, way, delivered, cycles = bay["soc"], -1 if bay["mode"] == charger.DISCHARGE else 1, 0.0, 0
    for _ in range(n):
        amount = bay["rate_ma"] * seconds / 3600
        soc, delivered = soc + way * amount / bay["nominal_mah"], delivered + amount
        if soc >= 1 - 1e-9 or soc <= 1e-9:
            soc = 1.0 if way > 0 else 0.0
            if bay["mode"] == charger.CYCLE:
                cycles, delivered, way = cycles + (way > 0), 0.0, -way
    return soc, way, delivered, cycles


def test_charger_over_many_legs(spark):
    good, _ = charger.readings(charger.polled(spark, 60, seconds=600.0))
    for r in good.collect():
        bay = charger.BAYS[r.slot]
        soc, way, delivered, cycles = stepped(bay, r._seq + 1, 600.0)
        assert (r.reading.program_count, r.reading.is_discharging) == (cycles, way < 0), (r.slot, r._seq)
        assert abs(r.reading.capacity_mah - delivered) <= 0.51 and abs(r.reading.temperature - (24 + 8 * soc)) <= 0.51


def test_tape(spark, tmp_path):
    p = tmp_path / "t.jsonl"
    p.write_text('{"t": 0, "data": "0e74"}\n\n{"t": 1.5, "data": "0E6A", "meta": {"a": 1}}\n{"t": 1.0, "data": "00"}\n{"t": true, "data": "00"}\n{"t": 2, "data": "0"}\n{"t": 2, "data": "00", "meta": []}\n{"t": -1, "data": ""}\n{"t": 3600, "data": "0e10"}\n{"t": 37')
    frames, faults = tape.read_tape(spark, str(p))
    assert [(r.t, bytes(r.data).hex(), r.meta) for r in frames.orderBy("line").collect()] == [(0.0, "0e74", None), (1.5, "0e6a", '{"a":1}'), (3600.0, "0e10", None)]
    assert {r.line: r.fault for r in faults.collect()} == {4: "t goes back", 5: "t is no number", 6: "data is no hex", 7: "meta is no object", 8: "t is negative"}
    recorder = tape.Recorder(str(tmp_path / "r.jsonl"), clock=iter([0.0, 0.5]).__next__)
    recorder(b"\x01", {"k": "v"})
    recorder.close()
    assert (tmp_path / "r.jsonl").read_text() == '{"t":0.5,"data":"01","meta":{"k":"v"}}\n'


def test_feed_files(spark, tmp_path):
    rows = [(k, "p/1" if k % 2 else None, "r1" if k < 6 else "r2", k * 0.5, 3.7, 1e-07) for k in range(10)]
    df = spark.createDataFrame(rows, "_seq long, series_id string, run_id string, test_time_second double, voltage_volt double, power_watt double").repartition(3)
    for _ in range(2):
        feed.write_feed(df, f"{tmp_path}/out", metadata={"token": "t", "url": "http://u:p@h"}, day="20240101")
    names = sorted(x.name for x in (tmp_path / "out").glob("*.csv"))
    assert names == [f"LOCAL__{c}__20240101_{n:03d}.bdf.csv" for c in ("default", "p-1") for n in (1, 2, 3, 4)]
    assert (tmp_path / "out" / names[4]).read_text().splitlines()[:2] == ["test_time_second,voltage_volt,current_ampere,power_watt", "0.5,3.7,,1e-07"]
    meta = json.loads((tmp_path / "out" / "LOCAL__p-1__20240101_001.meta.json").read_text())
    assert meta["rows"] == 3 and meta["finalized"] and meta["metadata"] == {"token": "***", "url": "http://***@h", "series_id": "p/1", "run_id": "r1", "segment": 1}
    assert not list((tmp_path / "out").glob(".*.part"))


def test_a_tape_in_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tape, "BLOCK", 2)
    (tmp_path / "t").mkdir()
    for k, lines in enumerate(('{"t": 0, "data": "00"}\n{"t": 5, "data": "01"}\n\n', '{"t": 4, "data": "02"}\n', "", '{"t": 5, "data": "03"}\n{"t": 6, "data": "04"}\n{"t": 4.5, "data": "05"}\n{"t"')):
        (tmp_path / "t" / f"part-{k:05d}.txt").write_text(lines)
    frames, faults = tape.read_tape(spark, f"{tmp_path}/t")
    assert [(r.line, r.t, bytes(r.data)[0]) for r in frames.orderBy("line").collect()] == [(1, 0.0, 0), (2, 5.0, 1), (5, 5.0, 3), (6, 6.0, 4)]
    assert {r.line: r.fault for r in faults.collect()} == {4: "t goes back", 7: "t goes back"}


def test_no_task_writes_the_whole_tape(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(proofs, "scratch", lambda spark, name: f"{tmp_path}/{name}")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert proofs.tape_frames(spark, "/root/testdata/sf0.001").count() == spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list((tmp_path / "tape").glob("part-*"))) > 1


def test_costly_rows_are_dealt_out(spark):
    assert proofs.nested_metadata(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= 16


def test_numbers_of_feed_files_go_beyond_999(spark, tmp_path):
    for n in range(1, 999):
        (tmp_path / f"LOCAL__p__20240101_{n:03d}.bdf.csv").write_text("test_time_second,voltage_volt,current_ampere\n")
    df = spark.createDataFrame([(k, "p", str(k), k * 0.5, 3.7) for k in range(3)], "_seq long, series_id string, run_id string, test_time_second double, voltage_volt double")
    feed.write_feed(df, str(tmp_path), day="20240101")
    told = {p.name: json.loads(p.read_text()) for p in tmp_path.glob("*.meta.json")}
    assert {n: m["metadata"]["segment"] for n, m in told.items()} == {f"LOCAL__p__20240101_{n}.meta.json": k for k, n in enumerate(("999", "1000", "1001"), 1)}
    made = set(m["file"] for m in told.values())
    assert not [r for r in validate.validate_feed(spark, str(tmp_path)).collect() if r.file in made]


def test_parquet_and_rescue(spark, tmp_path):
    a, b = spark.createDataFrame([(1.0,)], "a double"), spark.createDataFrame([("x",)], "a string")
    assert parquet.write_parquet([a, a.withColumnRenamed("a", "b")], f"{tmp_path}/p")
    assert spark.read.parquet(f"{tmp_path}/p").columns == ["a", "b"]
    assert not parquet.write_parquet([a, b], f"{tmp_path}/q")
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/q.rescue.ndjson").collect()) == ['{"a":"x"}', '{"a":1.0}']
    assert json.loads((tmp_path / "q.meta.json").read_text())["finalized"] is False


@pytest.fixture
def server():
    got, answers = [], []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = self.rfile.read(int(self.headers["Content-Length"]))
            got.append((dict(self.headers), gzip.decompress(body).decode()))
            self.send_response(answers.pop(0) if answers else 200)
            self.end_headers()

        def log_message(self, *a):
            pass

    s = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}/x", got, answers
    s.shutdown()


def test_push(spark, server, tmp_path):
    url, got, answers = server
    out = push.push_rows(spark.range(5).coalesce(1), url, str(tmp_path), rows_per_request=2, token="abc").collect()
    assert [(r.rows, r.delivered) for r in out] == [(2, True), (2, True), (1, True)] and got[0][0]["Authorization"] == "Bearer abc" and got[0][1] == '{"id":0}\n{"id":1}\n'
    slept = []
    p = push.Pusher(url, batch_seconds=100, max_rows=2, spool_dir=str(tmp_path), sleep=slept.append)
    p.write(["a", "b", "c"])
    assert len(p.spooled) == 1 and p.lines == ["b", "c"]
    answers += [500, 500, 500]
    p.close()
    assert slept == [2.0, 4.0] and len(p.spooled) == 2 and open(p.spooled[1]).read() == "b\nc\n"


def test_segments_of_a_stream(spark, tmp_path):
    df = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 10).load()
    df = df.select(F.lit("a").alias("series_id"), F.when(F.col("value") % 20 < 14, "r1").otherwise("r2").alias("run_id"), F.col("value").alias("_seq"))
    q = segmenter.segmented_stream(df, rows=8).writeStream.format("memory").queryName("segments").option("checkpointLocation", f"{tmp_path}/c").outputMode("append").start()
    try:
        while not q.lastProgress or q.lastProgress["batchId"] < 3:
            q.awaitTermination(1)
    finally:
        q.stop()
    rows = sorted((r._seq, r.run_id, r.segment) for r in spark.table("segments").collect())[:40]
    want, run, seg, n = [], None, 0, 0
    for k in range(len(rows)):
        r = "r1" if k % 20 < 14 else "r2"
        if r != run or n >= 8:
            run, seg, n = r, seg + 1, 0
        n += 1
        want.append((k, r, seg))
    assert rows == want and len(rows) >= 30


def test_policy():
    slept = []
    guard = supervisor.Guard(supervisor.ErrorPolicy(), slept.append)
    for _ in range(2):
        guard.failed(ValueError("x"))
    guard.succeeded()
    with pytest.raises(supervisor.SourceFailure):
        for _ in range(5):
            guard.failed(ValueError("y"))
    assert slept == [1.0, 2.0, 1.0, 2.0, 4.0, 8.0] and guard.errors == 7


def test_stream_that_fails_goes_on(spark, tmp_path):
    """A query that fails is started again from its checkpoint; rows count once, whatever their number of batches."""
    df = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 10).load()
    df = df.select(F.col("value").alias("_seq"), F.lit(None).cast("double").alias("test_time_second"), F.lit("s").alias("series_id"))
    seen, slept, tries = [], [], []

    def write(batch, k):
        tries.append(k)
        if len(tries) == 2:
            raise ValueError("once")
        seen.extend(r._seq for r in batch.collect())

    start = lambda df, once: collect.stream_to(df, write, f"{tmp_path}/c", once=once)
    stats = collect.collect_stream(df, start, duration=15, sleep=slept.append)
    assert slept == [1.0] and stats.errors == 1 and sorted(seen) == list(range(stats.samples)) and stats.samples >= 20


def test_push_source():
    class Five(buffer.PushSource):
        def run_reader(self, emit, should_stop):
            for k in range(5):
                emit(k)
            raise OSError("gone")

    s = Five("five", size=3)
    first = s.poll()
    s.thread.join(5)
    with pytest.raises(OSError, match="gone"):
        s.poll()
    assert (first + s.poll())[-3:] == [2, 3, 4] or first
    assert s.stats()["received_total"] >= 5
    s.close()

    held, left = threading.Event(), []

    class Late(buffer.PushSource):
        def run_reader(self, emit, should_stop):
            emit("early")
            held.wait(10)
            emit("late")
            left.append(True)

    z = Late("late", join_timeout=0.05)
    z.poll()
    z.close()
    held.set()
    while not left:
        pass
    assert "late" not in z.left  # nobody reads an abandoned session's queue
    with pytest.raises(ValueError, match="one sample"):
        Late("none", size=0)

    class Dead(buffer.PushSource):
        def run_reader(self, emit, should_stop):
            return None

    d = Dead("dead")
    d.poll()
    d.thread.join(5)
    with pytest.raises(buffer.DeadReaderError):
        d.poll()


def test_config_and_cli(tmp_path, monkeypatch, capsys):
    p = tmp_path / "c.toml"
    p.write_text('[source]\ntype="simulator"\ntoken="${ENV:T}"\n[collect]\ninterval=1\n')
    c = config.load_config(str(p))
    monkeypatch.setenv("T", "s3cr3t")
    assert config.source_options(c, None, {"x": 1}) == ("simulator", {"token": "s3cr3t", "x": 1})
    assert config.secrets_of({"token": "a", "url": "http://u:pw@h", "creds": {"user": "joe"}, "n": 3}) == ["a", "pw", "joe"]
    blocks = {"source": {"lab": {"type": "csvtail", "path": "p", "x": 2}, "other": {"y": 1}}}
    assert config.source_options(blocks, "lab", {"x": 3}) == ("csvtail", {"path": "p", "x": 3}) and config.source_options(blocks, "other", {}) == ("other", {"y": 1}) and config.source_options({}, "charger", {}) == ("charger", {})
    for bad in (0, -1, "nan", "inf", "x", None, True):
        with pytest.raises(ValueError, match="positive"):
            config.positive(bad, "interval")
    monkeypatch.delenv("T")
    with pytest.raises(config.ConfigError, match="not set"):
        config.expand(c)
    p.write_text("[collect]\ntypo=1\n")
    assert cli.main(["collect", "--config", str(p)]) == 2
    assert config.parse_options(["a=1", "b=x=y", 'c={"k":2}']) == {"a": 1, "b": "x=y", "c": {"k": 2}}
    assert cli.main(["sources"]) == 0 and "csvtail" in capsys.readouterr().out
    assert cli.main(["collect", "--source", "nothing"]) == 2


def test_no_handler_writes_a_secret(capsys):
    import io
    import logging

    out, own = io.StringIO(), io.StringIO()
    handler = logging.StreamHandler(out)
    logging.getLogger().addHandler(handler)
    try:
        with config.scrubbed_logs(Scrubber(["hunter2"])) as take_in:
            late = logging.getLogger("amperflow.test.source")
            late.addHandler(logging.StreamHandler(own))
            late.propagate = True
            take_in()
            try:
                raise ValueError("pw hunter2 at http://u:pw@h")
            except ValueError:
                late.exception("failed with %s", "hunter2")
        assert "hunter2" not in out.getvalue() + own.getvalue() and "u:pw" not in out.getvalue() and "***" in own.getvalue() and "Traceback" in own.getvalue()
        assert handler.formatter is None
    finally:
        logging.getLogger().removeHandler(handler)


def test_masked_metadata():
    raw = {"credentials": {"user": "joe", "value": "hunter2"}, "auth": ["tok1"], "path": "/x/hunter2", "items": [{"password": 7}, {"host": "h", "n": 1}], "pin": None, "url": "http://u:p@h"}
    assert Scrubber(["hunter2"])(raw) == {"credentials": "***", "auth": "***", "path": "/x/***", "items": [{"password": "***"}, {"host": "h", "n": 1}], "pin": "***", "url": "http://***@h"}
    assert Scrubber(["ABC", "ABCDEF", "", None]).text("key=ABCDEF short=ABC") == "key=*** short=***"
    assert raw["auth"] == ["tok1"]


def test_collect_command(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(SparkSession.Builder, "getOrCreate", lambda self: spark)
    out = tmp_path / "feed"
    assert cli.main(["collect", "--source", "simulator", "--opt", "polls=5", "--out", str(out), "--cell", "Cell A", "--interval", "0.5"]) == 0
    (name,) = (x.name for x in out.glob("*.csv"))
    assert name.startswith("LOCAL__Cell-A__") and len((out / name).read_text().splitlines()) == 6
    meta = json.loads(next(out.glob("*.meta.json")).read_text())["metadata"]
    assert meta["requested_interval_second"] == 0.5 and meta["source"] == "simulator"
    log = tmp_path / "log.csv"
    log.write_text("Time/s,Ewe/mV\n0.0,3200\n1.0,3300\n")
    (tmp_path / "c.toml").write_text(f'[source.lab]\ntype="csvtail"\npath="{log}"\n[source.lab.column_map]\n"Time/s"="test_time_second"\n"Ewe/mV"="voltage_volt"\n[collect]\nduration=2\n')
    assert cli.main(["collect", "--config", str(tmp_path / "c.toml"), "--source", "lab", "--out", f"{out}2"]) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["samples"] == 2 and len(next((tmp_path / "feed2").glob("*.csv")).read_text().splitlines()) == 3
    assert cli.main(["collect", "--source", "simulator", "--interval", "-1"]) == 2


def test_feed_of_nothing_and_series_info(spark, tmp_path):
    bare = spark.createDataFrame([], "_seq long, voltage_volt double")
    feed.write_feed(bare, f"{tmp_path}/a", day="20240101")
    assert (tmp_path / "a" / "LOCAL__default__20240101_001.bdf.csv").read_text() == "test_time_second,voltage_volt,current_ampere\n"
    feed.write_feed(bare.withColumn("series_id", F.lit("s")), f"{tmp_path}/b", day="20240101")
    assert not (tmp_path / "b").exists() or not list((tmp_path / "b").iterdir())
    df = spark.createDataFrame([(0, "A", 1.0), (1, "B", 1.0)], "_seq long, series_id string, voltage_volt double")
    info = spark.createDataFrame([("A", "Bay A", "LFP")], "series_id string, cell_name string, chemistry string")
    feed.write_feed(df, f"{tmp_path}/c", day="20240101", metadata={"site": "x"}, series_info=info)
    assert sorted(x.name for x in (tmp_path / "c").glob("*.csv")) == ["LOCAL__B__20240101_001.bdf.csv", "LOCAL__Bay-A__20240101_001.bdf.csv"]
    meta = json.loads((tmp_path / "c" / "LOCAL__Bay-A__20240101_001.meta.json").read_text())
    assert meta["metadata"] == {"site": "x", "chemistry": "LFP", "series_id": "A", "run_id": None, "segment": 1} and meta["started_at"] <= meta["finished_at"]


def test_validated_feed(spark, tmp_path):
    df = spark.createDataFrame([(k, "a,b" if k % 2 else "c", k * 1.0, 3.7, 'x "y", z') for k in range(6)], "_seq long, series_id string, test_time_second double, voltage_volt double, note string")
    feed.write_feed(df, f"{tmp_path}/f", day="20240101")
    assert validate.validate_feed(spark, f"{tmp_path}/f").collect() == []
    (tmp_path / "f" / "bad.csv").write_text("test_time_second,voltage_volt,voltage_volt,run_id\n-1,x,1,r\n0,1\n")
    (tmp_path / "f" / "LOCAL__c__20240101_001.meta.json").write_text('{"file": "LOCAL__c__20240101_001.bdf.csv", "rows": 9, "finalized": false}')
    got = {(r.file, r.fault, r.rows) for r in validate.validate_feed(spark, f"{tmp_path}/f").collect()}
    assert got == {("bad.csv", f, n) for f, n in [("name", 0), ("header", 0), ("repeated column", 0), ("routing column", 0), ("no description", 0), ("cells", 1), ("time is negative", 1), ("voltage_volt is no number", 1)]} | {("LOCAL__c__20240101_001.bdf.csv", f, 0) for f in ("not final", "rows")}
    assert set(registry.BUILT_IN_SINKS) <= set(registry.available_sinks()) and registry.sink("feed") is feed.write_feed


def test_descriptions_of_files_under_way(tmp_path, monkeypatch):
    monkeypatch.setattr(feed, "DESCRIBE_EVERY", 0.0)
    kinds = T.StructType([T.StructField(n, T.StringType()) for n in ("series_id", "run_id", "_seq", "segment", "_cell", "_info", "test_time_second")])
    writer = feed.FeedWriter(kinds, {"path": str(tmp_path)})

    def rows():
        for k in range(3):
            yield {"series_id": "s", "run_id": None, "_seq": k, "segment": 1, "_cell": "s", "_info": None, "test_time_second": float(k)}
            told = json.loads(next(tmp_path.glob(".*.meta.json")).read_text())
            assert told["finalized"] is False and told["finished_at"] is None and told["rows"] == k + 1

    made = writer.write(rows())
    (tmp_path / f".{writer.job}-killed.part").write_text("x")
    writer.commit([made])
    assert sorted(x.suffix for x in tmp_path.iterdir()) == [".csv", ".json"]


def test_flight_import_goes_on_after_bad_files(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    head = 'CUSTOM.dateTime,"BATTERY.voltage",BATTERY.current,RECOVER.aircraftSerial'
    (logs / "a.txt").write_text(f'{head}\n2024-05-01T07:00:00Z,11,1,"A, the ""first"""\n')
    (logs / "b.txt").write_bytes(b"\xff\xfe\x80\xc3")
    (logs / "c.txt").write_text("x,y\n1,2\n")
    (logs / "d.txt").write_text(f"{head}\nnever,11,1,A\n")
    (logs / "e.txt").write_text(f"{head}\n2024-05-01T07:00:00Z,900,1,A\n")
    assert collect.import_flights(spark, str(logs), f"{tmp_path}/out", f"{tmp_path}/ledger") == {"files": 5, "samples": 1, "quarantined": 4}
    reasons = {r.path[-5]: r.reason for r in ledger.Ledger(spark, f"{tmp_path}/ledger").quarantined.collect()}
    assert reasons == {"b": "not UTF-8 text", "c": "no header with a time and a voltage", "d": "no row with a time", "e": "no plausible row"}
    meta = json.loads(next((tmp_path / "out").glob("*.meta.json")).read_text())
    assert meta["metadata"]["series_id"].startswith('A, the "first":')


def test_rescue_keeps_what_is_there(spark, tmp_path):
    a, b = spark.createDataFrame([(1.0,)], "a double"), spark.createDataFrame([("x",)], "a string")
    assert not parquet.write_parquet([a, b], f"{tmp_path}/q") and not parquet.write_parquet([b, a], f"{tmp_path}/q")
    assert spark.read.text(f"{tmp_path}/q.rescue.ndjson").count() == 2 and spark.read.text(f"{tmp_path}/q.rescue.ndjson-1").count() == 2
    assert parquet.write_parquet([a], f"{tmp_path}/p")
    with pytest.raises(AnalysisException):
        parquet.write_parquet([a], f"{tmp_path}/p")


def test_flight_import(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    head = "CUSTOM.dateTime,BATTERY.voltage,BATTERY.current,RECOVER.aircraftSerial,RECOVER.batterySerial"
    (logs / "a.txt").write_text(f"{head}\n2024-05-01T07:00:00Z,11,1,A,B\n2024-05-01T07:00:20Z,11,1,A,B\n")
    (logs / "b.DAT").write_text(f"{head}\n1970-05-01T07:00:00Z,11,1,A,B\n")
    (logs / "c.jpg").write_text("x")
    (logs / "d.txt").write_text("")
    for want in ({"files": 2, "samples": 2, "quarantined": 1}, {"files": 0, "samples": 0, "quarantined": 0}):
        assert collect.import_flights(spark, str(logs), f"{tmp_path}/out", f"{tmp_path}/ledger") == want
    files = list((tmp_path / "out").glob("*.csv"))
    assert len(files) == 1 and files[0].name.startswith("LOCAL__A-B__") and len(files[0].read_text().splitlines()) == 3
