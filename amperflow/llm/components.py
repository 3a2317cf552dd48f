"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written


def _against_least(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (u, v) with the least v of their u as m, and those least ones.

    The least ones are written first, so that the join reads two shuffled tables and a hub's rows can be split.
    """
    least = written(rows.groupBy("u").agg(F.min("v").alias("m")), "least")
    return rows.join(least, "u"), least


def _large(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    joined, least = _against_least(both)
    return joined.where("v > u").select(F.col("v").alias("a"), F.least("u", "m").alias("b")), least


def _small(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    joined, least = _against_least(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    return joined.where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))), least


def _stepped(step, edges: DataFrame) -> DataFrame:
    """The edges after a step, written; the tables it read are dropped."""
    found, least = step(edges)
    after = written(found.where("a <> b").distinct(), "links")
    drop_written(least)
    drop_written(edges)
    return after


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b: long): root is the least node it reaches.

    Every step writes its edges in the shared folder; the driver sees counts and check sums only.
    Self-links and repeated links do no harm.
    """
    edges = written(links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b").distinct(), "links")
    before = None
    while True:
        sums = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if sums[0] == 0 or tuple(sums) == before:
            break
        before = tuple(sums)
        edges = _stepped(_small, _stepped(_large, edges))
    stars = edges.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return stars.union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
