"""Feed files of a stream, against those of one batch."""

import json
import os

import pytest
from pyspark.sql import functions as F

from amperflow.sinks import feed, feed_stream, validate

SCHEMA = "_seq long, series_id string, run_id string, test_time_second double, voltage_volt double, cycle_count long, note string"


def rows(first, n):
    return [(k, ["A", "a", None, "B/1"][k % 4], "r1" if k % 50 < 30 else "r2", k / 2, None if k % 7 == 0 else 3.5 + k / 100, None if k % 5 == 0 else (1 << 53) + k, f'x, "{k}" é') for k in range(first, first + n)]


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))


def put(spark, folder, name, data):
    spark.createDataFrame(data, SCHEMA).repartition(3).write.parquet(f"{folder}/.{name}")
    part = [x for x in os.listdir(f"{folder}/.{name}")]
    frame = spark.read.parquet(f"{folder}/.{name}").coalesce(1)
    frame.write.mode("overwrite").parquet(f"{folder}/_{name}")
    (one,) = (x for x in os.listdir(f"{folder}/_{name}") if x.endswith(".parquet"))
    os.rename(f"{folder}/_{name}/{one}", f"{folder}/{name}.parquet")
    assert part


def files(folder):
    return {x: open(f"{folder}/{x}", encoding="utf-8").read() for x in sorted(os.listdir(folder)) if x.endswith(".csv")}


def facts(folder, finalized=True):
    out = {}
    for x in sorted(os.listdir(folder)):
        if x.endswith(".meta.json"):
            m = json.load(open(f"{folder}/{x}", encoding="utf-8"))
            assert m["finalized"] is finalized or finalized is None
            out[x] = (m["file"], m["rows"], m["columns"], m["metadata"])
    return out


@pytest.fixture
def told(spark):
    return spark.createDataFrame([("B/1", "Bay", "LFP")], "series_id string, cell_name string, chemistry string")


def test_three_epochs_are_one_batch(spark, tmp_path, told):
    parts = [rows(0, 60), rows(60, 45), rows(105, 30)]
    (tmp_path / "in").mkdir()
    for k, p in enumerate(parts):
        put(spark, tmp_path / "in", f"p{k}", p)
    options = {"rows_per_file": 8, "day": "20240101", "metadata": {"token": "x", "site": "y"}, "series_info": told}
    run = feed_stream.stream_feed(stream(spark, tmp_path / "in"), str(tmp_path / "s"), str(tmp_path / "c"), once=True, **options)
    run.query.awaitTermination()
    assert run.query.lastProgress["batchId"] == 2
    run.finish()
    feed.write_feed(spark.createDataFrame([r for p in parts for r in p], SCHEMA), str(tmp_path / "b"), **options)
    got, want = files(tmp_path / "s"), files(tmp_path / "b")
    # Numbers go by arrival in both; within one epoch two cells may take theirs in another order, but each has its own.
    assert got == want and len(got) > 15
    assert facts(tmp_path / "s") == facts(tmp_path / "b")
    assert validate.validate_feed(spark, str(tmp_path / "s")).collect() == []


def test_files_stay_open_and_go_on_after_a_restart(spark, tmp_path):
    (tmp_path / "in").mkdir()
    start = lambda: feed_stream.stream_feed(stream(spark, tmp_path / "in"), str(tmp_path / "s"), str(tmp_path / "c"), day="20240101", once=True)
    for k in range(4):
        put(spark, tmp_path / "in", f"p{k}", [(k * 3 + j, "A", "r", 0.0, 1.0, j, "n") for j in range(3)])
        run = start()
        run.query.awaitTermination()
        assert len(files(tmp_path / "s")) == 1
        facts(tmp_path / "s", finalized=False)
    run.finish()
    assert len(next(iter(files(tmp_path / "s").values())).splitlines()) == 13
    assert next(iter(facts(tmp_path / "s").values()))[1] == 12


def appended(writer, spark, data):
    return writer.write(iter(spark.createDataFrame(data, "series_id string, run_id string, _seq long, _base string, _info string, voltage_volt double, segment long").collect()))


def test_repeated_epochs_and_attempts(spark, tmp_path):
    schema = spark.createDataFrame([], "series_id string, run_id string, _seq long, _base string, _info string, voltage_volt double, segment long").schema
    w = feed_stream.FeedStreamWriter(schema, {"path": str(tmp_path), "run": "x", "day": "20240101"})
    first = [("S", "r", 0, "S", None, 1.0, 1), ("S", "r", 1, "S", None, 2.0, 1), ("S", "q", 2, "S", None, 3.0, 2)]
    w.commit([appended(w, spark, first), None], 0)
    one = files(tmp_path)
    assert [x.splitlines() for x in one.values()] == [["voltage_volt", "1.0", "2.0"], ["voltage_volt", "3.0"]]
    # The epoch again: nothing is added, nothing left.
    w.commit([appended(w, spark, first)], 0)
    assert files(tmp_path) == one and not [x for x in os.listdir(tmp_path / ".feed-x") if x.endswith(".part")]
    more = [("S", "q", 3, "S", None, 4.0, 2), ("S", "z", 4, "S", None, 5.0, 3), ("T", "z", 5, "s", None, 6.0, 1)]
    # An attempt that is lost, then one that is doubled, then the commit.
    appended(w, spark, [*more[:1], ("S", "q", 9, "S", None, 9999.0, 2)])
    w.abort([appended(w, spark, more)], 1)
    assert files(tmp_path) == one
    appended(w, spark, more)
    again = appended(w, spark, more)
    # The driver dies in the middle of the commit: names are claimed, the epoch's number is not there.
    real = feed_stream.replaced
    feed_stream.replaced = lambda path, content: 1 / 0 if path.endswith("epoch") else real(path, content)
    with pytest.raises(ZeroDivisionError):
        w.commit([again], 1)
    feed_stream.replaced = real
    w.commit([appended(w, spark, more)], 1)
    two = files(tmp_path)
    assert sorted(x.splitlines()[1:] for x in two.values()) == [["1.0", "2.0"], ["3.0", "4.0"], ["5.0"], ["6.0"]]
    assert len([x for x in two if x.startswith("LOCAL__s-")]) == 1  # the same name but for case
    w.finish()
    facts(tmp_path)


def test_two_thousand_epochs(spark, tmp_path):
    """One file however often it goes on."""
    schema = spark.createDataFrame([], "series_id string, run_id string, _seq long, _base string, _info string, voltage_volt double, segment long").schema
    w = feed_stream.FeedStreamWriter(schema, {"path": str(tmp_path), "run": "x", "day": "20240101"})
    for k in range(2000):
        w.commit([w.write(iter([{"series_id": None, "run_id": None, "_seq": k, "_base": "default", "_info": None, "voltage_volt": float(k), "segment": 1}]))], k)
    (name,) = files(tmp_path)
    assert name == "LOCAL__default__20240101_001.bdf.csv" and len(files(tmp_path)[name].splitlines()) == 2001


def test_ages(spark, tmp_path):
    """Rotation by time cuts where rows of a micro-batch begin."""
    (tmp_path / "in").mkdir()
    for k in range(2):
        put(spark, tmp_path / "in", f"p{k}", [(k * 3 + j, "A", "r", 0.0, 1.0, j, "n") for j in range(3)])
    run = feed_stream.stream_feed(stream(spark, tmp_path / "in"), str(tmp_path / "s"), str(tmp_path / "c"), day="20240101", seconds_per_file=0.001, once=True)
    run.query.awaitTermination()
    assert len(files(tmp_path / "s")) == 2


def test_missing_columns(spark, tmp_path):
    """Routing and required columns that the stream does not have are null."""
    df = spark.createDataFrame([(0, "A", 1.0)], "_seq long, series_id string, voltage_volt double")
    df.coalesce(1).write.parquet(f"{tmp_path}/in/x")
    found = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in/x").withColumn("voltage_volt", F.col("voltage_volt") * 2)
    run = feed_stream.stream_feed(found, str(tmp_path / "s"), str(tmp_path / "c"), day="20240101", once=True)
    run.query.awaitTermination()
    assert list(files(tmp_path / "s").values()) == ["test_time_second,voltage_volt,current_ampere\n,2.0,\n"]
