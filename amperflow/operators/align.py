"""Rows of sibling tables lined up with status rows: by key, or by place where that is safe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text


def instance_key(name: Column, tag: Column) -> Column:
    """The lower-case instance name, else its tag, else null."""
    return F.coalesce(F.lower(text.clean(name)), F.concat(F.lit("tag:"), tag.cast("string")))


def align(statuses: DataFrame, rows: DataFrame, values: list[str], key: str = "key", place: str = "pos") -> DataFrame:
    """``statuses`` with the columns ``values`` of the row that belongs to each.

    By key first; of rows with one key the last counts. Status rows without a match take the row at
    their place, but only where both tables have as many rows. Otherwise values are null.
    """
    by_key = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*values), place).alias("__k"))
    by_place = rows.groupBy(place).agg(F.max_by(F.struct(*values), place).alias("__p"))
    sizes = rows.agg(F.count("*").alias("__n"), F.count(key).alias("__keys")).crossJoin(statuses.agg(F.count("*").alias("__m")))  # one row
    out = statuses.join(by_key, key, "left").join(by_place, place, "left").crossJoin(F.broadcast(sizes))
    safe = (F.col("__n") == F.col("__m")) & (F.col("__keys") == 0)
    chosen = F.coalesce("__k", F.when(safe | ((F.col("__n") == F.col("__m")) & F.col(key).isNull()), F.col("__p")))
    return out.select(*(F.col(c) for c in statuses.columns), *(chosen[v].alias(v) for v in values))


def filled(primary: Column, fallback: Column) -> Column:
    """The primary value; the fallback only where there is none."""
    return F.coalesce(primary, fallback)


def preferred_union(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """All of ``first``, and of ``second`` what ``first`` has no key for."""
    return first.unionByName(second.join(first.select(key).distinct(), key, "left_anti").select(*first.columns))


def enriched(df: DataFrame, info: DataFrame, key: str = "series_id", most: int = 100_000) -> DataFrame:
    """A lookup join; ``info`` is broadcast only while it has at most ``most`` rows."""
    small = info.limit(most + 1).count() <= most
    return df.join(F.broadcast(info) if small else info, key, "left")


def select_pack(packs: DataFrame, selector: int | str | None, name: str = "instance", place: str = "pos") -> DataFrame:
    """Packs by place (an int) or by name without regard to case; all without a selector."""
    if selector is None:
        return packs
    if isinstance(selector, int):
        return packs.where(F.col(place) == selector)
    return packs.where(F.lower(F.trim(name)) == selector.strip().lower())


def only_one(candidates: DataFrame, what: str) -> dict:
    """The single candidate; raises where there is none or more than one."""
    rows = candidates.limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"need exactly one {what}, found {'none' if not rows else 'several'}")
    return rows[0].asDict(recursive=True)
