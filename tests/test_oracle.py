"""Every query that has SQL gives the same rows as DuckDB on the smallest tables."""

import pytest

from amperflow.plans.captures import ORACLES, QUERIES

from .oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_same_as_sql(spark, con, name):
    assert compare(spark, con, SF, name, QUERIES[name], ORACLES[name]) >= 0


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).limit(5).count() == 5


def test_files_of_all_series(spark):
    files = QUERIES["file_sequence_names"](spark, SF)
    events = spark.read.parquet(f"{SF}/events.parquet")
    series = {f"user-{r.user_id}" for r in events.select("user_id").distinct().collect()}
    assert {r.series_id for r in files.select("series_id").distinct().collect()} == series
    assert files.select("file").distinct().count() == files.count()


def test_union_of_all_lines(spark):
    count = lambda name: spark.read.parquet(f"{SF}/{name}.parquet").count()
    assert QUERIES["union_ragged"](spark, SF).count() == count("lineitem") + count("orders")
