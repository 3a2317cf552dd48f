"""Operators on small tables, and against models in plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from amperflow.operators import align, contract, gate, ledger, project, segment, summary
from amperflow.sources.catalog import flight_lines


def model(rows, limit):
    """Routing as a loop over rows in order of arrival."""
    state, out = {}, []
    for seq, series, run in rows:
        s = state.setdefault(series, {"run": object(), "segment": 0, "rows": 0})
        if s["segment"] == 0 or run != s["run"] or (limit and s["rows"] >= limit):
            s.update(run=run, segment=s["segment"] + 1, rows=0)
        s["rows"] += 1
        out.append((seq, s["segment"]))
    return out


@pytest.mark.parametrize("limit", [None, 1, 3])
def test_segments_like_a_loop(spark, limit):
    rng = random.Random(limit or 0)
    rows = [(k, rng.choice([None, "a", "b"]), rng.choice([None, "r1", "r1", "r2"])) for k in range(600)]
    df = spark.createDataFrame(rows, "_seq long, series_id string, run_id string").repartition(3)
    assert sorted(map(tuple, segment.with_segments(df, limit).select("_seq", "segment").collect())) == model(rows, limit)


def test_exact_rows_leave_no_empty_segment(spark):
    df = spark.createDataFrame([(k, "a", "r") for k in range(9)], "_seq long, series_id string, run_id string")
    assert [r.rows for r in segment.manifest(segment.with_segments(df, 3)).orderBy("segment").collect()] == [3, 3, 3]


def test_cell_names(spark):
    df = spark.createDataFrame([("pack/1", 3), ("pack?1", 1), ("PACK-1", 2), (None, 5), ("default", 4), ("x", 6)], "series_id string, first_seq long")
    got = {r.series_id: r.cell for r in segment.cell_names(df).collect()}
    assert got["pack?1"] == "pack-1" and got["x"] == "x" and got[None] == "default"
    assert got["default"].startswith("default-") and len(got["default"]) == 16 and got["PACK-1"].startswith("PACK-1-") and got["pack/1"].startswith("pack-1-")
    assert len({v.lower() for v in got.values()}) == 6


def test_numbers_are_the_first_free_ones(spark):
    """Taken numbers are passed over, without regard to the cell's case; holes between them are used."""
    m = spark.createDataFrame([("Cell", 1, 10), ("cell", 2, 5)], "cell string, segment long, first_seq long")
    number = lambda *taken: [(r.seq, r.file) for r in segment.numbered_files(m, "I", F.lit("2024-01-01").cast("date"), taken=spark.createDataFrame([("CELL", "2024-01-01", n) for n in taken], "cell string, day string, seq int").withColumn("day", F.to_date("day"))).orderBy("seq").collect()]
    assert number(4) == [(1, "I__cell__20240101_001.bdf.csv"), (2, "I__Cell__20240101_002.bdf.csv")]
    assert number(1, 2, 4) == [(3, "I__cell__20240101_003.bdf.csv"), (5, "I__Cell__20240101_005.bdf.csv")]


def test_align(spark):
    s = spark.createDataFrame([(0, "b"), (1, "a"), (2, None)], "pos int, key string")
    r = spark.createDataFrame([(0, "a", 1.0), (1, "b", 2.0), (2, "a", 3.0)], "pos int, key string, v double")
    assert sorted((x.pos, x.v) for x in align.align(s, r, ["v"]).collect()) == [(0, 2.0), (1, 3.0), (2, 3.0)]
    keyless = r.withColumn("key", F.lit(None).cast("string"))
    plain = s.withColumn("key", F.lit(None).cast("string"))
    assert [x.v for x in align.align(plain, keyless, ["v"]).orderBy("pos").collect()] == [1.0, 2.0, 3.0]
    assert [x.v for x in align.align(plain, keyless.where("pos < 2"), ["v"]).orderBy("pos").collect()] == [None, None, None]
    assert align.only_one(s.where("pos = 0"), "row")["key"] == "b"
    with pytest.raises(ValueError, match="several"):
        align.only_one(s, "row")
    assert align.select_pack(s.withColumnRenamed("key", "instance"), " B").count() == 1 and align.select_pack(s, 2).count() == 1


HEAD = "CUSTOM.dateTime,BATTERY.voltage,BATTERY.current,BATTERY.chargeLevel,BATTERY.cellNum,BATTERY.cellVoltage1,BATTERY.cellVoltage2,BATTERY.cellVoltage3,RECOVER.aircraftSerial,RECOVER.batterySerial,OSD.isMotorOn,OSD.latitude,OSD.longitude"


def flights(spark, *lines, digest="abc123def456789"):
    return spark.createDataFrame([(digest, "\n".join([HEAD, *lines]))], "content_hash string, csv string")


def test_flight_gate(spark):
    files = flights(
        spark, "1970-01-01T00:00:00Z,11.3,1,100,3,3.8,3.8,3.8,AIR1,,false,,", "2024-05-01T07:41:52.969Z,11.25,6.217,66,3,3.75,3.75,3.75,,,true,-5.09e+195,9", "2024-05-01T07:31:27.776Z,11.3,6.217,100,3,3.765,3.774,3.739,,BAT1,true,48,9",
        "2024-05-01T07:50:00Z,999,1,50,3,3.8,3.8,3.8,,,false,,", "2024-05-01T07:51:00Z,13.119,1,50,3,3.765,3.774,3.739,,,false,,", "2024-05-01T07:52:00Z,NaN,1,50,3,,,,,,false,,",
    )
    samples, summaries, rejected = gate.normalize_flights(flight_lines(files), include_gps=True)
    got = samples.orderBy("test_time_second").collect()
    assert [r.test_time_second for r in got] == [0.0, 625.193] and got[0].current_ampere == -6.217 and got[0].series_id == "AIR1:BAT1" and got[0].run_id == "flight-abc123def456"
    assert got[0].cell_voltages == [3.765, 3.774, 3.739]
    s = summaries.first()
    assert (s.rows_total, s.records, s.bad_ts, s.implausible, s.soc_start_pct, s.soc_end_pct, s.motor_on_fraction) == (6, 2, 1, 3, 100, 66, 1.0)
    assert (s.last_position.lat, s.last_position.lon) == (48, 9) and rejected.count() == 4


def test_flight_without_serials(spark):
    s = gate.normalize_flights(flight_lines(flights(spark, "2024-05-01T07:50:00Z,11,1,,,,,,,,,,")))[1].first()
    assert s.series_id == "dji-drone:pack-abc123def456" and s.motor_on_fraction is None


def test_map_and_scale(spark):
    df = spark.createDataFrame([(0, "0.0", "3200", "-2.0"), (1, "1.0", "ERR", "1"), (2, "", "", ""), (3, "2", "", "7")], ["_seq", "Time/s", "Ewe/mV", "I/mA"])
    kept, bad = project.map_and_scale(df, {"Time/s": "test_time_second", "Ewe/mV": "voltage_volt", "I/mA": "current_ampere"}, {"Ewe/mV": 0.001, "I/mA": 0.001}, keep=("_seq",))
    assert [tuple(r) for r in kept.orderBy("_seq").collect()] == [(0, 0.0, 3.2, -0.002), (3, 2.0, None, 0.007)]
    assert sorted((r._seq, r.reject_reason) for r in bad.collect()) == [(1, "not a number"), (2, "empty")]


def test_phone(spark):
    df = spark.createDataFrame([({"current_now": "-420000", "voltage_now": "3910000", "temp": "312", "status": "Discharging"}, {}), ({}, {"status": "2", "current_now": "-250000", "level": "3", "scale": "6"})], "s map<string,string>, f map<string,string>")
    a, b = df.select(*project.phone_sample(F.col("s"), F.col("f"), include_soc=True)).collect()
    assert (a.voltage_volt, a.current_ampere, a.surface_temperature_celsius, a.charge_status) == (3.91, -0.42, 31.2, "Discharging")
    assert b.current_ampere == 0.25 and b.state_of_charge_percent == 50


def test_contract(spark):
    df = spark.createDataFrame([("a", None, 1.0, True), (None, -1.0, float("nan"), None), (None, 2.0, 3.0, None)], "series_id string, test_time_second double, v double, flag boolean")
    got = {r.rule: r.rows for r in contract.violations(df).collect()}
    assert got == {"v is not finite": 1, "flag has type boolean": 1, "time is negative": 1, "routed row without time": 1}
    with pytest.raises(AssertionError, match="negative"):
        contract.check(df)
    kept, bad = contract.split(df, contract.rules(df))
    assert kept.count() == 1 and bad.count() == 2
    a, b = spark.createDataFrame([(3.7, -0.5)], "v double, i double"), spark.createDataFrame([(-0.4, 25.0)], "i double, t double")
    assert contract.union_ragged(a, b).columns == ["v", "i", "t"]


def test_summaries(spark):
    df = spark.createDataFrame([(k,) for k in range(5)], "_seq long")
    assert sorted(r._seq for r in summary.newest(df.withColumn("s", F.lit("x")), 3, "_seq", "s").collect()) == [2, 3, 4]
    assert tuple(summary.buffer_stats(df.withColumn("s", F.lit("x")), 3, "s").first()) == ("x", 5, 2)
    d = spark.createDataFrame([("a", None), ("b", -70), ("c", -40)], "address string, rssi int")
    assert [r.address for r in summary.strongest(d).collect()] == ["c", "b", "a"]


def test_ledger(spark, tmp_path):
    ids = spark.createDataFrame([("h1", "a.txt"), (None, "empty.txt"), ("h2", "b.txt")], "content_hash string, path string")
    book = ledger.Ledger(spark, f"{tmp_path}/l")
    assert book.new(ids).count() == 3
    book.record(ids.where("path = 'a.txt' or content_hash is null"))
    bad = ids.where("path = 'b.txt'").withColumn("reason", F.lit("broken"))
    assert book.quarantine(bad) == 1 and book.quarantine(bad) == 0 and book.quarantine(bad.withColumn("reason", F.lit("other"))) == 1
    again = ledger.Ledger(spark, f"{tmp_path}/l")
    assert [r.path for r in again.new(ids).collect()] == ["empty.txt"] and again.quarantined.first().reason == "other" and again.ingested.count() == 1
    again.reset()
    assert again.new(ids).count() == 3
    (tmp_path / "l" / "ledger.json").write_text('{"version": 9}')
    (tmp_path / "l" / ".ledger.json.crc").unlink(missing_ok=True)
    with pytest.raises(ValueError, match="version"):
        ledger.Ledger(spark, f"{tmp_path}/l")


def test_segments_do_not_depend_on_blocks(spark):
    import random

    from amperflow.operators import segment

    rng = random.Random(3)
    rows, run = [], "a"
    for k in range(400):
        run = rng.choice(["a", "b", None]) if rng.random() < 0.15 else run
        rows.append((rng.choice(["s", "t", None]) if k > 150 else "s", run, 3 * k, "c"))
    df = spark.createDataFrame(rows, "series_id string, run_id string, _seq long, segment0 string")
    want, state = {}, {}
    for s, r, q, _ in rows:
        last, n, count = state.get(s, (object(), 0, 0))
        n, count = (n + 1, 1) if last != r or s not in state else (n, count + 1)
        state[s] = (r, n, count)
        want[q] = n
    for block in (7, 64, 1 << 20):
        assert {r._seq: r.segment for r in segment.with_segments(df, block=block).collect()} == want
        turns = {r._seq: r.segment for r in segment.with_segments(df, rows=4, block=block).collect()}
        state = {}
        for s, r, q, _ in rows:
            last, n, count = state.get(s, (object(), 0, 0))
            n, count = (n + 1, 1) if s not in state or last != r or count == 4 else (n, count + 1)
            state[s] = (r, n, count)
            assert turns[q] == n, (block, s, q)
    assert segment.with_segments(df).columns == [*df.columns, "segment"]
