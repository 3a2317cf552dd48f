"""Projections from device readings to canonical samples."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as names
from ..functions import units
from ..functions.bind import bound
from ..schema import RESERVED, ordered_columns


def map_and_scale(df: DataFrame, columns: Mapping[str, str], scale: Mapping[str, float] | None = None, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected): text columns renamed, read as numbers and scaled.

    An empty cell is missing; one cell that is no number rejects its row; a row without any value is
    rejected as well. Scales are keyed by the source column. ``keep`` passes other columns on.
    """
    scale = scale or {}
    cell = {s: F.nullif(F.trim(F.col(f"`{s}`").cast("string")), F.lit("")) for s in columns}
    value = {s: units.strict_double(cell[s]) * F.lit(float(scale.get(s, 1.0))) for s in columns}
    bad = F.lit(False)
    for s in columns:
        bad = bad | (cell[s].isNotNull() & value[s].isNull())
    empty = F.coalesce(*cell.values()).isNull()
    marked = df.withColumn("__why", F.when(bad, "not a number").when(empty, "empty"))
    kept = marked.where(F.col("__why").isNull()).select(*(F.col(f"`{k}`") for k in keep), *(value[s].alias(d) for s, d in columns.items()))
    return kept, marked.where(F.col("__why").isNotNull()).withColumnRenamed("__why", "reject_reason")


def charger_sample(r: Column, time_base: str = "collection") -> list[Column]:
    """Columns of a decoded charger reading: volts, signed amperes and ampere-hours, temperature; device time on request."""
    if time_base not in ("collection", "device"):
        raise ValueError("time_base is 'collection' or 'device'")
    sign = F.when(r["status_code"] == 2, -1.0).otherwise(1.0)
    out = [(r["voltage_mv"] / 1000.0).alias("voltage_volt"), (sign * r["current_ma"] / 1000.0).alias("current_ampere"), r["temperature"].cast("double").alias("surface_temperature_celsius"), (sign * r["capacity_mah"] / 1000.0).alias("cumulative_capacity_ah")]
    return [*out, r["elapsed_s"].cast("double").alias("test_time_second")] if time_base == "device" else out


def unwrap_timer(df: DataFrame, window, timer: str = "elapsed_s", wrap: int = 65_536) -> DataFrame:
    """An unwrapped run timer: each step back of the 16-bit counter adds a turn."""
    back = (F.col(timer) < F.lag(timer).over(window)).cast("long")
    return df.withColumn("__back", F.coalesce(back, F.lit(0).cast("long"))).withColumn("unwrapped_s", F.col(timer) + F.sum("__back").over(window.rowsBetween(Window.unboundedPreceding, 0)) * wrap).drop("__back")


def power_pack(status: Mapping[str, Column], full: Column, cycles: Column) -> list[Column]:
    """Columns of a pack's status row: V, W, A, state of charge, cycles; unknown rates count as 0."""
    known = {k: units.known_number(v) for k, v in status.items()}
    volt = known["voltage_mv"] / 1000.0
    power = (F.coalesce(known["charge_mw"], F.lit(0.0)) - F.coalesce(known["discharge_mw"], F.lit(0.0))) / 1000.0
    return [volt.alias("voltage_volt"), power.alias("power_watt"), units.current_of(power, volt).alias("current_ampere"), units.state_of_charge(known["remaining_mwh"], units.known_number(full)).alias("state_of_charge_percent"), units.known_number(cycles).cast("long").alias("cycle_count")]


def phone_sample(sysfs: Column, fields: Column, include_soc: bool = False) -> list[Column]:
    """Columns of a phone capture: ``sysfs`` and ``fields`` are maps of text; sysfs wins, the dump fills in.

    Current comes from the first of current_now, current_avg and the dump, signed by the status.
    """
    # Each number is bound before its unit is guessed: rules that name their input several times, one
    # in another, would write it out a thousand times.
    of = lambda m, k: bound(F.try_element_at(m, F.lit(k)), units.strict_double)
    unit = lambda rule, *numbers: F.coalesce(*(bound(x, rule) for x in numbers))
    code = bound(of(fields, "status").cast("int"), names.battery_status)
    status = F.coalesce(names.clean(F.try_element_at(sysfs, F.lit("status"))), code)
    current = unit(units.amperes, of(sysfs, "current_now"), of(sysfs, "current_avg"), of(fields, "current_now"))
    volt = unit(units.volts, of(sysfs, "voltage_now"), of(fields, "voltage"))
    warm = unit(units.celsius, F.coalesce(of(sysfs, "temp"), of(fields, "temperature")))
    signed = bound(current, lambda c: bound(status, lambda s: units.signed_by_status(c, s)))
    out = [volt.alias("voltage_volt"), signed.alias("current_ampere"), warm.alias("surface_temperature_celsius"), status.alias("charge_status")]
    if include_soc:
        level = bound(of(fields, "level"), lambda n: bound(of(fields, "scale"), lambda most: units.level_percent(n, most)))
        out.append(F.coalesce(unit(units.clamped_percent, of(sysfs, "capacity")), level).alias("state_of_charge_percent"))
    return out


def stamped(df: DataFrame, elapsed: Column | float) -> DataFrame:
    """Samples without a time of their own get the batch's elapsed time."""
    own = F.col("test_time_second") if "test_time_second" in df.columns else F.lit(None).cast("double")
    return df.withColumn("test_time_second", F.coalesce(own, elapsed if isinstance(elapsed, Column) else F.lit(float(elapsed))))


def without_routing(df: DataFrame) -> DataFrame:
    return df.drop(*RESERVED)


def feed_columns(df: DataFrame) -> DataFrame:
    """The trio (null where the data lack it), then all else sorted: what a feed file holds."""
    present = set(df.columns)
    return df.select(*(F.col(f"`{c}`") if c in present else F.lit(None).cast("double").alias(c) for c in ordered_columns(present)))


def flat_cells(df: DataFrame, most: int = 14) -> DataFrame:
    """``cell_voltages`` as columns ``cell_N_voltage_volt``, as many as any row has (at most ``most``)."""
    n = df.agg(F.max(F.size("cell_voltages"))).first()[0] or 0
    return df.select("*", *(F.get("cell_voltages", k).alias(f"cell_{k + 1}_voltage_volt") for k in range(min(max(n, 0), most)))).drop("cell_voltages")


def non_null_map(fields: Mapping[str, Column]) -> Column:
    """A map of the fields that have a value, as text."""
    entries = F.array(*(F.struct(F.lit(k).alias("k"), v.cast("string").alias("v")) for k, v in fields.items()))
    return F.map_from_entries(F.filter(entries, lambda e: e.v.isNotNull()))
