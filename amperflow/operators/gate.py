"""Plausibility gate and normalization of flight logs, one DataFrame of rows for many files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text, units

MOST_CELLS = 14
DRONE, PACK = "dji-drone", "pack"


def pack_window(volt: Column, cells: Column) -> Column:
    """Whether a pack voltage fits its number of cells: 2.0 to 4.6 V each, or 0.1 to 60 V where that is unknown."""
    known = cells.between(1, MOST_CELLS)
    return F.when(known, volt.between(cells * 2.0, cells * 4.6)).otherwise(volt.between(0.1, 60.0))


def reject_reason(volt: Column, current: Column, warm: Column, soc: Column, cell_count: Column, cells: Column) -> Column:
    """Why a reading is implausible; null where it is not."""
    total = F.aggregate(cells, F.lit(0.0), lambda a, x: a + x)
    return (
        F.when(volt.isNull(), "no voltage").when(current.isNull(), "no current").when(~F.coalesce(pack_window(volt, cell_count), pack_window(volt, F.lit(0.0))), "pack voltage").when(F.abs(current) > 200, "current")
        .when(~warm.between(-40, 100), "temperature").when(~soc.between(0, 100), "state of charge").when(~F.forall(cells, lambda x: x.between(0, 5.0)), "cell voltage")
        .when((F.size(cells) > 0) & (F.abs(volt - total) > 0.5), "cell sum")
    )


def flight_rows(logs: DataFrame) -> DataFrame:
    """Parsed columns of flight-log rows; ``logs`` has content_hash, _seq and the log's text columns (dotted names)."""
    have = set(logs.columns)
    raw = lambda c: F.col(f"`{c}`") if c in have else F.lit(None).cast("string")
    num = lambda c: units.strict_double(raw(c))
    cells = text.leading_cells(F.array(*(num(f"BATTERY.cellVoltage{k}") for k in range(1, MOST_CELLS + 1))))
    out = logs.select(
        "content_hash", "_seq", text.instant(raw("CUSTOM.dateTime")).alias("ts"), num("BATTERY.voltage").alias("v"), num("BATTERY.current").alias("i"), num("BATTERY.temperature").alias("temp"), num("BATTERY.chargeLevel").alias("soc"),
        num("BATTERY.cellNum").alias("cell_num"), cells.alias("cells"), num("OSD.height").alias("height"), (raw("OSD.isMotorOn") == "true").alias("motor"), num("BATTERY.currentCapacity").alias("remaining"), num("BATTERY.fullCapacity").alias("full"),
        text.position(num("OSD.latitude"), num("OSD.longitude")).alias("gps"), text.clean(raw("RECOVER.aircraftSerial")).alias("aircraft_serial"), text.clean(raw("RECOVER.batterySerial")).alias("battery_serial"),
        text.clean(raw("OSD.droneType")).alias("drone_type"), text.clean(raw("RECOVER.aircraftName")).alias("aircraft_name"),
    )
    why = F.when(F.col("ts").isNull(), "bad_ts").when(reject_reason(*(F.col(c) for c in ("v", "i", "temp", "soc", "cell_num", "cells"))).isNotNull(), "implausible")
    return out.withColumn("reject", why)


def normalize_flights(logs: DataFrame, include_gps: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(samples, summaries, rejected) of flight-log rows of any number of files.

    Identity is the first non-empty value over all rows in file order, also of rejected ones; time
    starts at the earliest kept row; context is taken from kept rows in order of time. A file
    without any kept row has a summary with 0 records and no samples.
    """
    rows = flight_rows(logs)
    kept = F.col("reject").isNull()
    first = lambda c: F.min_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col("_seq"))).alias(c)
    at = F.struct("ts", "_seq")
    last = lambda c: F.max_by(F.col(c), F.when(kept & F.col(c).isNotNull(), at))
    begin = lambda c: F.min_by(F.col(c), F.when(kept & F.col(c).isNotNull(), at))
    motor = F.count_if(kept & F.coalesce(F.col("motor"), F.lit(False)))
    records = F.count_if(kept)
    summary = rows.groupBy("content_hash").agg(
        *(first(c) for c in ("aircraft_serial", "battery_serial", "drone_type", "aircraft_name")), F.count("*").alias("rows_total"), records.alias("records"), F.count_if(F.col("reject") == "bad_ts").alias("bad_ts"),
        F.count_if(F.col("reject") == "implausible").alias("implausible"), F.min(F.when(kept, F.col("ts"))).alias("started"), F.max(F.when(kept, F.col("ts"))).alias("ended"), F.max(F.when(kept, F.col("height"))).alias("max_height_m"),
        begin("soc").alias("soc_start_pct"), last("soc").alias("soc_end_pct"), last("remaining").alias("remaining_capacity_mah"), last("full").alias("full_capacity_mah"), F.when(motor > 0, F.round(motor / records, 4)).alias("motor_on_fraction"),
        F.max(F.when(kept, F.size("cells"))).alias("cell_columns"), *([last("gps").alias("last_position")] if include_gps else []),
    )
    uid = F.substring("content_hash", 1, 12)
    summary = summary.withColumn("run_id", F.concat(F.lit("flight-"), uid)).withColumn(
        "series_id", text.stream_key(F.coalesce("aircraft_serial", F.lit(DRONE)), F.coalesce("battery_serial", F.concat(F.lit(f"{PACK}-"), uid)))
    )
    summary = summary.withColumn("test_time_span_second", F.round(F.timestamp_diff("MICROSECOND", "started", "ended") / 1e6, 6))
    samples = rows.where(kept).join(summary.select("content_hash", "series_id", "run_id", "started"), "content_hash")
    samples = samples.select(
        "series_id", "run_id", F.round(F.timestamp_diff("MICROSECOND", "started", "ts") / 1e6, 6).alias("test_time_second"), F.round("v", 6).alias("voltage_volt"), F.round(-F.col("i"), 6).alias("current_ampere"),
        F.round(F.col("v") * -F.col("i"), 6).alias("power_watt"), F.round("temp", 3).alias("surface_temperature_celsius"), F.transform("cells", lambda x: F.round(x, 6)).alias("cell_voltages"), "_seq",
    )
    return samples, summary, rows.where(~kept)


def zero_based(df: DataFrame, ts: str, *keys: str) -> DataFrame:
    """Seconds since the first row of each key, as ``test_time_second``."""
    start = F.min(ts).over(Window.partitionBy(*keys))
    return df.withColumn("test_time_second", F.timestamp_diff("MICROSECOND", start, F.col(ts)) / F.lit(1e6))
