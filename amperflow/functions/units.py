"""Units, signs and plausible numbers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What Windows battery classes report for an unknown number. Fixed value.
UNKNOWN_NUMBER = 0x80000000
CAPACITY_RELATIVE = 0x40000000
NUMERAL = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def strict_double(text: Column) -> Column:
    """A finite number from trimmed text, else null: no type suffixes, names of infinities or NaN."""
    t = F.trim(text.cast("string"))
    value = F.when(t.rlike(NUMERAL), t.try_cast("double"))
    return F.when(F.abs(value) < float("inf"), value)


def _scaled(x: Column, steps: list[tuple[float, float]]) -> Column:
    x = x.cast("double")
    out = None
    for at_least, divisor in steps:
        branch = F.abs(x) >= at_least
        out = F.when(branch, x / divisor) if out is None else out.when(branch, x / divisor)
    return out.otherwise(x)


def volts(x: Column) -> Column:
    """Microvolts from 100,000 up, millivolts from 100 up, else volts."""
    return _scaled(x, [(100_000, 1e6), (100, 1e3)])


def amperes(x: Column) -> Column:
    """Microamperes from 10,000 up, milliamperes from 100 up, else amperes; charge and energy likewise."""
    return _scaled(x, [(10_000, 1e6), (100, 1e3)])


ampere_hours = watt_hours = amperes


def celsius(x: Column) -> Column:
    """Tenths of a degree above 100, else degrees: 95 stays 95."""
    x = x.cast("double")
    return F.when(F.abs(x) > 100, x / 10).otherwise(x)


def clamped_percent(x: Column) -> Column:
    x = x.cast("double")
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), x)))


def level_percent(level: Column, scale: Column) -> Column:
    """Level as a percentage of its scale; a scale of null, 0 or 100 means the level is one."""
    usual = scale.isNull() | scale.isin(0, 100)
    return F.when(usual, clamped_percent(level)).otherwise(clamped_percent(level.cast("double") * 100 / F.nullif(scale.cast("double"), F.lit(0.0))))


def known_number(x: Column) -> Column:
    """A number, null where it is the unknown sentinel (of either sign)."""
    x = x.cast("double")
    return F.when(F.abs(x) != float(UNKNOWN_NUMBER), x)


def state_of_charge(remaining: Column, full: Column) -> Column:
    """Percentage of the full charge within 0 and 100; null where either is unknown or full is not positive."""
    ok = remaining.isNotNull() & (full > 0)
    return F.when(ok, clamped_percent(F.lit(100.0) * remaining / full))


def current_of(power: Column, volt: Column) -> Column:
    """Current from power; 0 where the voltage is not positive."""
    return F.when(volt > 0, power / volt).otherwise(F.lit(0.0))


def signed_by_status(current: Column, status: Column) -> Column:
    """Positive while charging, negative while discharging, else as it is."""
    s = F.lower(F.trim(status))
    return F.when(s == "charging", F.abs(current)).when(s == "discharging", -F.abs(current)).otherwise(current)


def capacity_relative(flags: Column) -> Column:
    """True where the pack declares relative capacities, else null."""
    return F.when(flags.cast("long").bitwiseAND(F.lit(CAPACITY_RELATIVE)) != 0, F.lit(True))


def backoff(k: Column, initial: float = 1.0, factor: float = 2.0, most: float = 30.0) -> Column:
    """Seconds to wait after the k-th failure in a row."""
    return F.least(F.lit(initial) * F.pow(F.lit(factor), k.cast("double") - 1), F.lit(most))


def simulated_sample(step: Column, steps: int = 3600, current: float = 0.002, full: float = 3.0, empty: float = 2.0, ambient: float = 25.0) -> list[Column]:
    """Voltage, current and temperature of a cell that discharges along a parabola."""
    x = F.least(step.cast("double") / steps, F.lit(1.0))
    volt = F.lit(empty) + F.lit(full - empty) * (F.lit(1.0) - x * x)
    warm = F.lit(ambient) + F.lit(0.5) * F.sin(step.cast("double") / 30)
    return [F.round(volt, 6).alias("voltage_volt"), F.lit(-abs(current)).alias("current_ampere"), F.round(warm, 6).alias("surface_temperature_celsius")]
