"""The conformance kit finds what breaks the rules, and nothing else."""

import pytest
from pyspark.sql import functions as F

from amperflow import conformance as C
from amperflow.sources import catalog
from amperflow.streaming.buffer import PushSource


class Good:
    name = "good"

    def __init__(self, *batches, metadata=None, **change):
        self.batches, self.told, self.closed = list(batches), metadata or {"k": 1}, 0
        self.__dict__ |= change

    def poll(self):
        return self.batches.pop(0) if self.batches else []

    def metadata(self):
        return self.told

    def close(self):
        self.closed += 1


def test_good_sources_pass(spark):
    good = Good([{"voltage_volt": 3.7}], [{"series_id": "a", "run_id": "r", "test_time_second": 0, "x": None}])
    C.check(C.polled_faults(good))
    assert good.closed == 2
    C.check(C.maker_faults(spark, catalog.simulator, polls=3))
    C.check(C.maker_faults(spark, catalog.charger, polls=3, time_base="device"))

    class Received(PushSource):
        def run_reader(self, emit, should_stop):
            emit({"voltage_volt": 1.0})

    C.check(C.polled_faults(Received("received"), polls=1))


ROW = {"voltage_volt": 1.0}


@pytest.mark.parametrize(
    ("source", "fault"),
    [
        (Good(name="  "), "name"), (Good(metadata={"k": object()}), "no JSON"), (Good(metadata={"k": float("nan")}), "no JSON"), (Good(metadata=[1]), "mapping"), (Good(metadata={1: 2}), "not text"), (Good(({},)), "list"), (Good([[1]]), "dict"),
        (Good([{1: 2.0}]), "not text"), (Good([{"x": [1]}]), "neither"), (Good([{"x": True}]), "neither"), (Good([{"x": float("inf")}]), "finite"), (Good([{"series_id": "a"}]), "routed"), (Good([{"series_id": 1, "test_time_second": 0}]), "not text"),
        (Good([{"test_time_second": "0"}]), "number"), (Good([{"test_time_second": -1.0}]), "number"), (Good([ROW, ROW]), "more than once"), (Good([ROW], [ROW]), "more than once"), (Good(availability=lambda: 3), "availability"),
    ],
)
def test_faults_are_found(source, fault):
    with pytest.raises(AssertionError, match=fault):
        C.check(C.polled_faults(source))
    assert source.closed == 2


def test_faults_of_makers(spark):
    with pytest.raises(AssertionError, match="_seq.*not finite"):
        C.check(C.maker_faults(spark, lambda s: s.range(2).select(F.lit(float("nan")).alias("voltage_volt"))))
    with pytest.raises(AssertionError, match="session"):
        C.check(C.maker_faults(spark, lambda: None))
    with pytest.raises(ValueError, match="once"):
        list(C.polled_faults(Good(), polls=0))
