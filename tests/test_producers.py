"""Producers of rows as table functions."""

import pytest

from amperflow.sources import producers


def halves(name, content):
    for k, line in enumerate(content.split(b"\n")):
        if line == b"bad":
            raise producers.Refused("a bad line")
        if line == b"bug":
            raise KeyError("bug")
        if line:
            yield {"v": float(line), "k": k, "name": name, "more": 1}


def test_samples_and_reasons(spark):
    files = spark.createDataFrame([("a", b"1\n\n2.5", 7), ("b", b"1\nbad", 8), ("c", b"1\nbug", 9), ("d", None, 1), ("e", b"", 2), ("f", b"\n", 3), ("a", b"4", 7), (None, b"5", 0)], "path string, content binary, site int")
    samples, refused = producers.produce(files, halves, "v double, k long, missing string, name string")
    assert samples.columns == ["path", "site", "v", "k", "missing", "name", "_seq"]
    got = sorted((str(r.path), r.site, r.v, r.k, r.missing, str(r.name), r._seq) for r in samples.collect())
    assert got == [("None", 0, 5.0, 0, None, "None", 0), ("a", 7, 1.0, 0, None, "a", 0), ("a", 7, 2.5, 2, None, "a", 1), ("a", 7, 4.0, 0, None, "a", 0)]
    assert {r.path: r._reason for r in refused.collect()} == {"b": "a bad line", "c": "KeyError: 'bug'", "d": "empty", "e": "empty", "f": "no rows"}
    with pytest.raises(ValueError, match="site"):
        producers.produce(files, halves, "site int")
    with pytest.raises(ValueError, match="_seq"):
        producers.produce(files, halves, "_seq long")


def test_columns_follow_from_the_query(spark):
    spark.udtf.register("halves", producers.table_function(halves))
    assert [f.simpleString() for f in spark.sql("SELECT * FROM halves('x', CAST('1' AS BINARY), 'v double')").schema] == ["v:double", "_seq:bigint", "_reason:string"]
    assert spark.sql("SELECT t.v FROM VALUES ('x', CAST('1' AS BINARY)), ('y', CAST('2' AS BINARY)) AS f(p, c), LATERAL halves(f.p, f.c, 'v double') AS t ORDER BY 1").collect() == [(1.0,), (2.0,)]


def test_no_files(spark):
    samples, refused = producers.produce(spark.createDataFrame([], "path string, content binary"), halves, "v double")
    assert samples.count() == 0 and refused.count() == 0
