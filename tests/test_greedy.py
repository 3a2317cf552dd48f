"""Greedy choices, rotation by time and framing, against loops."""

import random

import pytest
from pyspark.sql import functions as F

from amperflow.operators import greedy


def loop(places, gap):
    out, last = [], None
    for p in sorted(set(places)):
        if last is None or p - last >= gap:
            out.append(p)
            last = p
    return out


@pytest.mark.parametrize("bits,gap", [(16, 7), (3, 1), (3, 7), (3, 40), (2, 1000), (3, 10**9)])
def test_greedy(spark, monkeypatch, bits, gap):
    """Groups of one row and of many blocks, with gaps below, of and beyond a block."""
    r = random.Random(bits * gap)
    groups = {("a", None): [r.randrange(3000) for _ in range(400)], ("a", "x"): [5], (None, "x"): [r.randrange(50) for _ in range(60)], ("b", "y"): [k * 7 for k in range(90)], ("hot", ""): [r.randrange(-500, 9000) for _ in range(1500)]}
    rows = [(*k, p, "clash") for k, ps in groups.items() for p in ps]
    df = spark.createDataFrame(rows, "s string, q string, place long, g string").repartition(5)
    monkeypatch.setattr(greedy, "BITS", bits)
    got = sorted((str(x.s), str(x.q), x.place) for x in greedy.greedy(df, ["s", "q"], "place", gap).collect())
    assert got == sorted((str(s), str(q), p) for (s, q), ps in groups.items() for p in loop(ps, gap))


def test_nothing(spark):
    assert greedy.greedy(spark.createDataFrame([], "s string, place long"), ["s"], "place", 3).count() == 0


def test_rotation_by_time(spark):
    """Runs, row limits and ages together, over blocks, with times that are missing or go back."""
    import datetime

    from amperflow.operators import segment

    r = random.Random(3)
    start = datetime.datetime(2024, 1, 1)
    rows, clock = [], 0
    for k in range(400):
        clock += r.choice([0, 1, 5, 30, -10])
        rows.append(("s" if k % 5 else None, "a" if k % 70 < 50 else "b", k, None if r.random() < 0.2 else start + datetime.timedelta(seconds=clock)))
    want, state = {}, {}
    for s, run, k, ts in rows:
        seg, was, began, now, n = state.get(s, (0, object(), None, None, 0))
        if run != was or n >= 40:
            seg, began, now, n = seg + 1, None, None, 0
            aged = False
        else:
            aged = True
        now = max((x for x in (now, ts) if x is not None), default=None)
        if aged and began is not None and now is not None and (now - began).total_seconds() >= 20:
            seg, began = seg + 1, now
        began = now if began is None else began
        want[k] = seg
        state[s] = seg, run, began, now, n + 1
    df = spark.createDataFrame(rows, "series_id string, run_id string, _seq long, ts timestamp").repartition(3)
    for block in (1 << 20, 32):
        got = {x._seq: x.segment for x in segment.with_aged_segments(df, 20, "ts", rows=40, block=block).select("_seq", "segment").collect()}
        assert got == want


def test_free_numbers(spark):
    from amperflow.operators import segment

    r = random.Random(5)
    taken = {c: sorted(r.sample(range(1, 60), n)) for c, n in (("a", 20), ("b", 59 - 10), ("c", 0), ("d", 1))}
    wanted = [(c, k) for c in "abcd" for k in range(r.randrange(1, 50))]
    df = spark.createDataFrame(wanted, "cell string, k int").repartition(3)
    held = spark.createDataFrame([(c, n) for c, ns in taken.items() for n in ns] * 2 + [("a", 0), ("a", -3), ("zz", 1)], "cell string, seq long")
    got = {(x.cell, x.k): x.seq for x in segment.free_numbers(df, ["cell"], "k", held).collect()}
    for c in "abcd":
        free = (n for n in range(1, 1000) if n not in taken[c])
        assert [got[c, k] for cc, k in wanted if cc == c] == [next(free) for cc, _ in wanted if cc == c]
    files = segment.numbered_files(spark.createDataFrame([("C", 1), ("C", 2)], "cell string, first_seq long"), "L", F.to_date(F.lit("2024-01-01")), taken=spark.createDataFrame([("c", 5)], "cell string, seq long").withColumn("day", F.to_date(F.lit("2024-01-01"))))
    assert sorted(x.seq for x in files.collect()) == [1, 2]


def damaged(r, n):
    out = b""
    for _ in range(n):
        body = bytes([0x0F, 0x55]) + bytes(r.choice([0x0F, 0, 255, r.randrange(256)]) for _ in range(17))
        frame = body + bytes([sum(body) & 255])
        out += r.choice([frame, frame, frame, frame[:7], b"\x0f\x0f" + frame, b"\x01" * 5, b"", frame[:-1] + b"\x00", bytes(40)])
    return out


@pytest.mark.parametrize("page", [21, 64, 1 << 20])
def test_framing(spark, page):
    """Streams cut anywhere, pieces shorter than a frame and longer than a page, against a reader."""
    from amperflow.functions.frames import reassemble
    from amperflow.operators import framing

    r = random.Random(page)
    rows, want = [], set()
    for device, n in (("a", 60), (None, 9), ("b", 0), ("c", 300)):
        data = damaged(r, n)
        found, _ = reassemble(data)
        want |= {(str(device), k, f) for k, f in enumerate(found)}
        at, chunk = 0, 0
        while at < len(data) or chunk == 0:
            size = r.choice([0, 1, 2, 19, 20, 21, 200])
            rows.append((device, chunk, None if not size else bytearray(data[at : at + size])))
            at, chunk = at + size, chunk + 1
    df = spark.createDataFrame(rows, "device string, chunk long, data binary").repartition(4)
    got = {}
    for x in framing.framed(df, page=page).collect():
        got.setdefault(str(x.device), []).append((x.place, bytes(x.frame)))
    assert {(d, k, f) for d, fs in got.items() for k, (_, f) in enumerate(sorted(fs))} == want
    pieces = framing.placed(df, "device", "chunk", "data", block=7).collect()
    assert len(pieces) == len(rows) and all(x.start >= 0 for x in pieces)


def test_framing_of_a_stream(spark, tmp_path):
    """What is left over of a micro-batch is the beginning of the next one's first frame."""
    from amperflow.functions.frames import reassemble
    from amperflow.operators import framing

    r = random.Random(1)
    streams = {d: damaged(r, 40) for d in ("a", "b")}
    for part in range(4):
        rows = []
        for d, data in streams.items():
            cuts = [len(data) * k // 37 for k in range(38)]
            rows += [(d, k, bytearray(data[cuts[k] : cuts[k + 1]])) for k in range(37) if k * 4 // 37 == part]
        spark.createDataFrame(rows, "device string, chunk long, data binary").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema("device string, chunk long, data binary").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = framing.framed_stream(source).writeStream.format("memory").queryName("framed").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    for d, data in streams.items():
        got = [bytes(x.frame) for x in spark.table("framed").where(F.col("device") == d).orderBy("frame_no").collect()]
        assert got == reassemble(data)[0] and len(got) > 10


def test_groups_of_a_block_need_no_pointers(spark, monkeypatch):
    monkeypatch.setattr(greedy, "chosen", None)
    df = spark.createDataFrame([(None if s == 3 else f"s{s}", p) for s in range(9) for p in range(0, 40 * s, 3)], "s string, place long").repartition(5)
    got = sorted((str(r.s), r.place) for r in greedy.greedy(df, ["s"], "place", 10).collect())
    assert got == sorted(("None" if s == 3 else f"s{s}", p) for s in range(9) for p in range(0, 40 * s, 12))
