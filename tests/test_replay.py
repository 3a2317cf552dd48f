"""Tapes as streams, on a clock that the tests set."""

import json
import random
import time

import pytest

from amperflow.sources import replay


def tape(path, r, n):
    times, lines = [], []
    t = 0.0
    for k in range(n):
        t += r.choice([0, 0.5, 0.25, 3])
        times.append(t)
        lines.append(json.dumps({"t": t, "data": f"{k:04x}"} | ({"meta": {"k": "é"}} if k % 3 == 0 else {})))
        lines += r.choice([[], [], [""], ["no frame"], ['{"t": "x", "data": ""}'], ["[1]"], ["{}", "1"]])
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    return times


@pytest.mark.parametrize("n", [0, 1, 2, 40])
def test_halving(tmp_path, n):
    path = tmp_path / "x.tape"
    times = tape(path, random.Random(n), n)
    size = path.stat().st_size
    for t in [-1, 0, 0.1, *times, *(x + 0.1 for x in times), 1e9, float("inf")]:
        end = replay.reached(str(path), t)
        with open(path, "rb") as f:
            got = [found[0] for _, line in replay.lines_from(f, 0, end) if (found := replay.frame(line))]
        assert got == [x for x in times if x <= t] and end <= size
        assert replay.reached(str(path), t) == end
    assert replay.reached(str(tmp_path / "none"), 5) == 0


def run(spark, tmp_path, got, split=1 << 20, **options):
    q = replay.replayed(spark, str(tmp_path / "x.tape"), split=split, **options).writeStream.foreachBatch(lambda b, _: got.extend((r.t, r.data.hex(), r.meta) for r in b.orderBy("_seq").collect())).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()


@pytest.mark.parametrize("split", [7, 1 << 20])
def test_paced_and_restarted(spark, tmp_path, split):
    times = tape(tmp_path / "x.tape", random.Random(7), 60)
    got, anchor = [], tmp_path / "anchor"
    for t in (-1.0, times[10], times[10], times[30], times[-1] + 1):
        # The tape began so long ago that it has just got to t.
        anchor.write_text(json.dumps({"began": time.time() - t / 1e-6}))
        before = len(got)
        run(spark, tmp_path, got, split, pace=1e-6, anchor=str(anchor))
        assert [x[0] for x in got] == [x for x in times if x <= t + 1e-3] and len(got) >= before
    assert [x[1] for x in got] == [f"{k:04x}" for k in range(60)] and got[0][2] == '{"k":"é"}' and got[1][2] is None


def test_at_once_and_growing(spark, tmp_path):
    path, got = tmp_path / "x.tape", []
    path.write_text('{"t": 0, "data": "01"}\n{"t": 5, "da')
    run(spark, tmp_path, got)
    with path.open("a") as f:
        f.write('ta": "02"}\n')
    run(spark, tmp_path, got)
    assert got == [(0.0, "01", None), (5.0, "02", None)]
    spark.dataSource.register(replay.TapeSource)
    assert spark.read.format("tape").option("path", str(path)).option("split", 3).load().count() == 2
    run(spark, tmp_path, got)
    assert len(got) == 2
    with pytest.raises(ValueError, match="anchor"):
        replay.replayed(spark, str(path), pace=1.0)


def test_first_start_makes_the_anchor(spark, tmp_path):
    times = tape(tmp_path / "x.tape", random.Random(1), 10)
    got = []
    run(spark, tmp_path, got, pace=1e9, anchor=str(tmp_path / "anchor"))
    run(spark, tmp_path, got, pace=1e9, anchor=str(tmp_path / "anchor"))
    assert [x[0] for x in got] == times and json.loads((tmp_path / "anchor").read_text())["began"] <= time.time()
