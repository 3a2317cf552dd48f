"""The tail of CSV files in byte ranges: one partition or many, a batch or a stream, the same records."""

import csv
import io
import random

import pytest

from amperflow.sources import catalog, csvtail


def content(r, n):
    out = io.StringIO()
    w = csv.writer(out, lineterminator="\n")
    w.writerow(["a", "b,c", "note\nof two"])
    rows = []
    for k in range(n):
        note = r.choice(["x", 'say "hi"', "two\nlines", "\n\n", "", "é\r\nü", ",", '"', "long " * 9])
        rows.append((str(k), str(k * k), note))
        w.writerow(rows[-1])
        if r.random() < 0.1:
            out.write(r.choice(["\n", "\r\n", " , \n"]))
    return out.getvalue(), rows


def load(spark, path, split, survey, **more):
    spark.dataSource.register(csvtail.CsvTailSource)
    reader = spark.read.format("csvtail").option("path", str(path)).option("columns", "a,missing").option("split", split)
    for k, v in more.items():
        reader = reader.option(k, v)
    return reader.option("surveyed", csvtail.surveyed(spark, str(path), split)).load() if survey else reader.load()


@pytest.mark.parametrize("survey", [False, True])
@pytest.mark.parametrize("split", [1, 7, 40, 300, 1 << 20])
def test_ranges_are_one_file(spark, tmp_path, monkeypatch, survey, split):
    monkeypatch.setattr(csvtail, "BLOCK", 64)
    text, rows = content(random.Random(split), 120)
    (tmp_path / "log.csv").write_text(text + '999,1,"under way\n', newline="")
    df = load(spark, tmp_path / "log.csv", split, survey)
    got = df.orderBy("_seq").collect()
    assert [r.a for r in got] == [a for a, _, _ in rows] and {r.missing for r in got} == {None}
    assert len({r._seq for r in got}) == len(got)
    assert [r._seq for r in got] == [r._seq for r in load(spark, tmp_path / "log.csv", 1 << 20, False).orderBy("_seq").collect()]
    if split < 100:
        assert df.rdd.getNumPartitions() > 4


def test_cells(tmp_path):
    text, rows = content(random.Random(2), 300)
    (tmp_path / "log.csv").write_text(text, newline="")
    scan = csvtail.Scan(str(tmp_path / "log.csv"))
    scan.on(10**9)
    parts = csvtail.ranges(scan.path, csvtail.Scan(scan.path).told(), scan.told(), 100)
    assert len(parts) > 20
    got = [r for p in parts for r in csvtail.records(["a", "b,c", "note\nof two"], p, "utf-8")]
    assert [r[:3] for r in got] == rows


def test_stream_of_files(spark, tmp_path):
    """Files grow, files come, records under way wait, also within quotation marks and over a restart."""
    folder = tmp_path / "logs"
    folder.mkdir()
    got = []

    def run(split):
        spark.dataSource.register(csvtail.CsvTailSource)
        df = spark.readStream.format("csvtail").option("path", str(folder)).option("columns", "t,n").option("split", split).load()
        q = df.writeStream.foreachBatch(lambda b, _: got.extend((r._file[-5], r._seq, r.t, r.n) for r in b.collect())).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        q.awaitTermination()

    (folder / "a.csv").write_text('t,n\n1,x\n2,"two\nlines')
    (folder / "b.csv").write_text("t")
    run(4)
    assert got == [("a", 0, "1", "x")]
    with (folder / "a.csv").open("a") as f:
        f.write('"\n3,z\n4')
    with (folder / "b.csv").open("a") as f:
        f.write(",n\n7,y\n")
    (folder / "c.csv").write_text("n,t\np,9\n")
    run(4)
    assert sorted(got[1:]) == [("a", 1, "2", "two\nlines"), ("a", 2, "3", "z"), ("b", 0, "7", "y"), ("c", 0, "9", "p")]
    run(1 << 20)
    assert len(got) == 5


def test_series_by_file_and_nothing(spark, tmp_path):
    options = {"column_map": {"v": "voltage_volt"}}
    assert catalog.csvtail(spark, f"{tmp_path}/*.csv", **options).count() == 0
    (tmp_path / "x.csv").write_text("v\n3.5\n")
    (tmp_path / "y.csv").write_text("\n\nv\n3.25\n")
    (tmp_path / "empty.csv").write_text("")
    out = catalog.csvtail(spark, str(tmp_path), by_file=True, **options).collect()
    assert sorted((r.series_id, r.voltage_volt) for r in out) == [("x", 3.5), ("y", 3.25)]
    with pytest.raises(Exception, match="ASCII"):
        load(spark, tmp_path, 10, False, encoding="utf-16").collect()


def test_a_header_alone_among_files(spark, tmp_path):
    """As Spark writes it where the first of its partitions has no rows."""
    (tmp_path / "a.csv").write_text("v\n")
    (tmp_path / "b.csv").write_text("v\n3.5\n")
    (tmp_path / "c.csv").write_text("v")
    out = catalog.csvtail(spark, str(tmp_path), {"v": "voltage_volt"}, by_file=True).collect()
    assert [(r.series_id, r.voltage_volt) for r in out] == [("b", 3.5)]
    (tmp_path / "b.csv").unlink()
    assert catalog.csvtail(spark, str(tmp_path), {"v": "voltage_volt"}).count() == 0
