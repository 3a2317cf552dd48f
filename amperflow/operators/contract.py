"""Rules that samples have to keep, as tables of violations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALLOWED = ("double", "float", "bigint", "int", "smallint", "tinyint", "string")


def rules(df: DataFrame) -> dict[str, Column]:
    """Rule name and the condition under which a row breaks it."""
    kinds = dict(df.dtypes)
    out: dict[str, Column] = {}
    for name, kind in kinds.items():
        c = F.col(f"`{name}`")
        if not name.strip():
            out["empty column name"] = F.lit(True)
        if kind in ("double", "float"):
            out[f"{name} is not finite"] = F.isnan(c) | (F.abs(c) == float("inf"))
        elif kind not in ALLOWED:
            out[f"{name} has type {kind}"] = c.isNotNull()
    for name in ("series_id", "run_id"):
        if name in kinds and kinds[name] != "string":
            out[f"{name} is not text"] = F.col(name).isNotNull()
    if "test_time_second" in kinds and kinds["test_time_second"] in ("double", "float", "bigint", "int"):
        t = F.col("test_time_second")
        out["time is negative"] = t < 0
        if "series_id" in kinds:
            out["routed row without time"] = F.col("series_id").isNotNull() & t.isNull()
    elif "series_id" in kinds:
        out["routed row without time"] = F.col("series_id").isNotNull()
    return out


def violations(df: DataFrame) -> DataFrame:
    """(rule, rows) of the rules that rows break, in one pass."""
    checks = rules(df)
    if not checks:
        return df.sparkSession.createDataFrame([], "rule string, rows long")
    counts = df.agg(*(F.count_if(F.coalesce(c, F.lit(False))).alias(f"r{k}") for k, c in enumerate(checks.values())))
    pairs = F.array(*(F.struct(F.lit(r).alias("rule"), F.col(f"r{k}").alias("rows")) for k, r in enumerate(checks)))
    return counts.select(F.explode(pairs).alias("x")).select("x.*").where("rows > 0")


def check(df: DataFrame) -> None:
    """Raises with all broken rules."""
    broken = violations(df).collect()
    if broken:
        raise AssertionError("; ".join(f"{r.rule}: {r.rows} rows" for r in broken))


def split(df: DataFrame, reasons: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected): rejected rows carry the first reason that holds."""
    why = reduce(lambda acc, kv: F.when(F.coalesce(kv[1], F.lit(False)), kv[0]).otherwise(acc), reversed(list(reasons.items())), F.lit(None).cast("string"))
    marked = df.withColumn("reject_reason", why)
    return marked.where(F.col("reject_reason").isNull()).drop("reject_reason"), marked.where(F.col("reject_reason").isNotNull())


def union_ragged(*frames: DataFrame) -> DataFrame:
    """All rows under the union of all columns, in the order in which columns are first seen."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
