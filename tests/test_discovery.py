"""Candidates that sources find, and what the command line says of them."""

import json

import pytest

from amperflow.sources import discovery, registry
from amperflow.streaming import cli


@pytest.fixture
def bench(tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.csv").write_text("x\n1\n")
    (tmp_path / "deep" / "b.csv").write_text("y\n")
    (tmp_path / "deep" / "empty.csv").write_text("")
    (tmp_path / "deep" / "c.ndjson").write_text("{}\n")
    (tmp_path / "d.bin").write_bytes(b"\0")
    return tmp_path


def told(capsys, *words):
    code = cli.main(["discover", *map(str, words)])
    return code, capsys.readouterr()


def test_candidates_are_files_by_suffix_in_all_folders(spark, bench):
    rows = discovery.candidates(spark, "csvtail", str(bench)).collect()
    assert sorted((r.value.rsplit("/", 1)[1], r.bytes, r.ready, r.option) for r in rows) == [("a.csv", 4, True, "path"), ("b.csv", 2, True, "path")]


def test_only_the_listing_is_read(spark, bench):
    plan = discovery.candidates(spark, "csvtail", str(bench))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan


def test_a_sweep_goes_on_over_sources_that_fail_or_cannot_run(spark, bench, monkeypatch):
    def broken(spark):
        return None

    def absent(spark):
        return None

    def listed(spark):
        return None

    broken.discover = lambda spark, path: 1 / 0
    absent.discover, absent.unavailable = lambda spark, path: [], lambda: "no adapter"
    listed.discover = lambda spark, path, most=1: [("address", f"dev-{k}", None, None, True) for k in range(int(most))]
    known = {**registry.available_sources(), "broken": broken, "absent": absent, "listed": listed}
    monkeypatch.setattr(registry, "available_sources", lambda: known)
    found, notes = discovery.sweep(spark, str(bench))
    assert {r.source for r in found.collect()} == {"csvtail", "flightlog", "phone", "listed"}
    assert notes == {"broken": "failed: division by zero", "absent": "skipped: no adapter"}
    assert [r.value for r in discovery.candidates(spark, "listed", "", most="2").collect()] == ["dev-0", "dev-1"]
    assert discovery.candidates(spark, "absent", "").count() == 0  # asked for by name, it is tried


def test_command_line(spark, bench, capsys):
    code, said = told(capsys, "--path", bench, "--json")
    out = json.loads(said.out)
    assert code == 0 and out["notes"] == {} and {k: len(v) for k, v in out["candidates"].items()} == {"csvtail": 2, "flightlog": 2, "phone": 1}
    code, said = told(capsys, "--path", bench, "--source", "csvtail")
    assert code == 0 and f"-> collect --source csvtail --opt path=file:{bench}/a.csv" in said.out
    empty = bench / "empty"
    empty.mkdir()
    assert told(capsys, "--path", empty)[1].out == "nothing found\n"


@pytest.mark.parametrize("words", [("--source", "nothing"), ("--source", "simulator"), ("--opt", "a=b"), ("--source", "phone", "--opt", "unknown=1"), ("--source", "phone", "--path", "/no/such/folder")])
def test_wrong_use(spark, words, capsys):
    code, said = told(capsys, *words)
    assert code == 2 and said.err.startswith("error: ")
