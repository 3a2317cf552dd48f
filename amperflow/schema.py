"""The canonical sample schema and its vocabulary."""

from __future__ import annotations

from pyspark.sql import types as T

TRIO = ("test_time_second", "voltage_volt", "current_ampere")
RESERVED = ("series_id", "run_id")
ARRIVAL = ("_batch_id", "_seq")

SAMPLE = T.StructType(
    [T.StructField(n, T.StringType()) for n in RESERVED]
    + [T.StructField(n, T.DoubleType()) for n in (*TRIO, "power_watt", "surface_temperature_celsius", "cumulative_capacity_ah", "state_of_charge_percent")]
    + [
        T.StructField("cycle_count", T.LongType()),
        T.StructField("charge_status", T.StringType()),
        T.StructField("cell_voltages", T.ArrayType(T.DoubleType())),
        T.StructField("extras", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("extras_str", T.MapType(T.StringType(), T.StringType())),
        T.StructField("_batch_id", T.LongType()),
        T.StructField("_seq", T.LongType()),
    ]
)


def ordered_columns(columns) -> list[str]:
    """The required trio first, whatever else there is sorted; routing and arrival columns left out."""
    rest = sorted(set(columns) - set(TRIO) - set(RESERVED) - set(ARRIVAL))
    return [*TRIO, *rest]
