"""A simulated four-bay charger that answers with real frames, each a function of time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import frames

#: Bays of the simulated device. Fixed values.
BAYS = [
    {"slot": 0, "present": True, "battery": 0, "mode": 0, "nominal_mah": 3000.0, "rate_ma": 1000.0, "low": 3.0, "high": 4.2, "soc": 0.15},
    {"slot": 1, "present": True, "battery": 0, "mode": 3, "nominal_mah": 2500.0, "rate_ma": 500.0, "low": 3.0, "high": 4.2, "soc": 0.92},
    {"slot": 2, "present": True, "battery": 3, "mode": 4, "nominal_mah": 2000.0, "rate_ma": 1000.0, "low": 1.0, "high": 1.45, "soc": 0.5},
    {"slot": 3, "present": False, "battery": 0, "mode": 0, "nominal_mah": 3000.0, "rate_ma": 1000.0, "low": 3.0, "high": 4.2, "soc": 0.2},
]
DISCHARGE, CYCLE = 3, 4


def bay_state(n: Column, seconds: float) -> dict[str, Column]:
    """The fields of a bay after ``n`` steps, as a closed form of time over the bay's columns.

    The first leg runs from the state of charge at the start to full or flat; in cycle mode legs of
    equal length follow, down and up in turn, and each begins to count anew. In other modes charge
    stops at the ends, but is counted on. A finished leg never shows as completed: the status always
    is that of the direction.
    """
    c = {k: F.col(k) for k in BAYS[0]}
    on, down_first = c["present"], c["mode"] == DISCHARGE
    amount = c["rate_ma"] * F.lit(seconds / 3600)  # mAh a step
    part = amount / c["nominal_mah"]
    first, leg = F.ceil((1 - c["soc"]) / part), F.ceil(1 / part)  # steps
    turned = on & (c["mode"] == CYCLE) & (n >= first)
    m = n - first
    k, j = F.floor(m / leg), F.pmod(m, leg)
    way = F.when(turned, F.when(k % 2 == 0, -1).otherwise(1)).when(down_first, -1).otherwise(1)
    straight = F.greatest(F.lit(0.0), F.least(F.lit(1.0), c["soc"] + way * n * part))
    soc = F.when(~on, c["soc"]).when(turned, F.when(way < 0, 1 - j * part).otherwise(j * part)).otherwise(straight)
    steps, elapsed = F.when(turned, j).otherwise(n), F.when(on, n * int(seconds)).otherwise(0).cast("int")
    volt = c["low"] + soc * (c["high"] - c["low"]) + way * 0.08 + F.sin(elapsed / 30) * 0.004
    whole = lambda x: F.when(on, F.bround(x).cast("int")).otherwise(0)
    return {
        "slot": c["slot"], "battery_type_code": c["battery"], "mode_code": c["mode"], "program_count": F.when(turned, 1 + F.floor(k / 2)).otherwise(0).cast("int"), "status_code": F.when(on, F.when(way < 0, 2).otherwise(1)).otherwise(0), "elapsed_s": elapsed,
        "voltage_mv": whole(volt * 1000), "current_ma": F.when(on, c["rate_ma"].cast("int")).otherwise(0), "capacity_mah": whole(steps * amount), "temperature": F.when(on, F.bround(24 + 8 * soc).cast("int")).otherwise(24),
        "resistance_mohm": F.when(on, 45).otherwise(0), "led_bits": F.when(on, F.pow(F.lit(2), c["slot"] + F.when(way < 0, 0).otherwise(4)).cast("int")).otherwise(0),
    }


def polled(spark: SparkSession, polls: int, seconds: float = 1.0, bays: list[dict] | None = None) -> DataFrame:
    """slot, _seq and frame of so many polls of every bay."""
    known = spark.createDataFrame([tuple(b[k] for k in BAYS[0]) for b in bays or BAYS], "slot int, present boolean, battery int, mode int, nominal_mah double, rate_ma double, low double, high double, soc double")
    df = spark.range(polls).select(F.col("id").alias("_seq")).crossJoin(F.broadcast(known))  # as many bays as a device has
    state = bay_state(F.col("_seq") + 1, seconds)
    df = df.select("_seq", *(v.alias(f"__{k}" if k in ("slot",) else k) for k, v in state.items()))
    return df.select(F.col("__slot").alias("slot"), "_seq", frames.encode_progress(F.struct(F.col("__slot").alias("slot"), *(F.col(k) for k in state if k != "slot"))).alias("frame"))


def readings(captured: DataFrame, occupied_only: bool = True) -> tuple[DataFrame, DataFrame]:
    """(decoded, rejected) frames; empty bays are left out on request."""
    df = captured.withColumn("__d", frames.decoded(F.col("frame"))).withColumn("reject_reason", F.col("__d.reject_reason")).withColumn("reading", F.col("__d.reading")).drop("__d")
    good = df.where(F.col("reject_reason").isNull()).drop("reject_reason", "frame")
    return (good.where(F.col("reading.occupied")) if occupied_only else good), df.where(F.col("reject_reason").isNotNull()).drop("reading")
