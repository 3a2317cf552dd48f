"""The keyed table under the ledger: merges, snapshots, and crashes between them."""

import os

import pytest

from amperflow.operators.ledger import Ledger
from amperflow.sinks import keyed

SCHEMA = "k string, v string, at long"


def live(t):
    return {r.k: (r.v, r["at"]) for r in t.rows().collect()}


def test_merges(spark, tmp_path):
    t = keyed.KeyedTable(spark, f"{tmp_path}/t", SCHEMA, "k", "at", buckets=4)
    put = lambda *rows: t.merge(spark.createDataFrame(rows, SCHEMA))
    assert live(t) == {}
    put(("a", "1", 1), ("b", "1", 1), (None, "x", 9), ("a", "0", 0), ("c", None, 5))
    put(("a", "2", 2), ("d", "1", 1), ("c", "old", 4), ("b", "0", 1))
    want = {"a": ("2", 2), "b": ("1", 1), "c": (None, 5), "d": ("1", 1)}
    assert live(t) == want
    put()
    assert live(t) == want and live(keyed.KeyedTable(spark, f"{tmp_path}/t", SCHEMA, "k", "at", buckets=4)) == want
    t.clear()
    assert live(t) == {}


def test_crash_before_the_swap(spark, tmp_path, monkeypatch):
    t = keyed.KeyedTable(spark, f"{tmp_path}/t", SCHEMA, "k", "at", buckets=2)
    t.merge(spark.createDataFrame([("a", "1", 1)], SCHEMA))
    before, real = t.snapshot(), keyed.KeyedTable._put
    for fails in ("snapshot", "CURRENT"):
        monkeypatch.setattr(keyed.KeyedTable, "_put", lambda self, name, content, fails=fails: 1 / 0 if name.startswith(fails) else real(self, name, content))
        with pytest.raises(ZeroDivisionError):
            t.merge(spark.createDataFrame([("a", "2", 2), ("b", "1", 1)], SCHEMA))
        assert t.snapshot() == before and live(t) == {"a": ("1", 1)}
    monkeypatch.setattr(keyed.KeyedTable, "_put", real)
    t.merge(spark.createDataFrame([("b", "3", 3)], SCHEMA))
    assert live(t) == {"a": ("1", 1), "b": ("3", 3)}
    # What the crashes left is gone.
    names = [x for x in os.listdir(f"{tmp_path}/t") if not x.startswith(".")]
    assert len([x for x in names if x.startswith("snapshot-")]) == 2 and len([x for x in names if x.startswith("data-")]) <= 2


def test_many_imports_leave_one_snapshot(spark, tmp_path):
    """And a reader of the snapshot before still finds its files."""
    book = Ledger(spark, f"{tmp_path}/l")
    for k in range(12):
        held = book.ingested if k else None
        book.record(spark.createDataFrame([(f"h{k % 5}", f"/p{k}")], "content_hash string, path string"))
        if held is not None:
            assert held.count() == min(k, 5)
    assert {r.content_hash: r.path for r in book.ingested.collect()} == {"h0": "/p10", "h1": "/p11", "h2": "/p7", "h3": "/p8", "h4": "/p9"}
    names = os.listdir(f"{tmp_path}/l/ingested")
    assert len([x for x in names if x.startswith("snapshot-")]) == 2
    parts = sum(f.endswith(".parquet") for _, _, fs in os.walk(f"{tmp_path}/l/ingested") for f in fs)
    assert parts <= 2 * keyed.BUCKETS
