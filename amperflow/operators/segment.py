"""Segments of endless streams, their numbers and their file names. Shuffles go by series and block of places."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..scratch import stored
from .greedy import greedy

DEFAULT = "default"


#: Places of a series that one task takes at most: series are cut into blocks of so many, and what happens at the cuts is carried over.
BLOCK = 1 << 20


def _carried(df: DataFrame, keys: list[str], before: dict[str, Column], sums: dict[str, Column]) -> DataFrame:
    """``df`` with what all earlier blocks of its series add up to: ``before`` (over a window of blocks) of the sums of each block."""
    per = df.groupBy(*keys).agg(*(v.alias(k) for k, v in sums.items()))
    per = per.select(*(F.col(k).alias(f"__of{i}") for i, k in enumerate(keys)), *(v.alias(k) for k, v in before.items()))
    same = reduce(and_, (F.col(k).eqNullSafe(F.col(f"__of{i}")) for i, k in enumerate(keys)))
    return df.join(per, same).drop(*(f"__of{i}" for i in range(len(keys))))


def with_segments(df: DataFrame, rows: int | None = None, series: str = "series_id", run: str = "run_id", seq: str = "_seq", block: int = BLOCK) -> DataFrame:
    """``df`` with ``segment``: 1-based per series; a new one with every change of run and every ``rows`` rows.

    A run that comes back starts another segment. Null series are one series, null runs one run. The
    places of a series are cut into blocks, so that no series is one task. ``df`` is read once: one
    sorted pass counts within blocks and is written; from one row a block follows what each block
    begins with, and that is joined to the rows. So a ``_seq`` that another reading would give anew is
    no harm.
    """
    names, keys = [F.col(f"`{c}`") for c in df.columns], [series, "__block"]
    within = Window.partitionBy(*keys).orderBy(seq)
    up_to = within.rowsBetween(Window.unboundedPreceding, 0)
    place, began, opens = F.col("__place"), F.col("__began"), F.col("__opens")
    cut = df.withColumn("__block", F.floor(F.col(seq) / block)).withColumn("__place", F.row_number().over(within).cast("long"))
    change = (place > 1) & ~F.col(run).eqNullSafe(F.lag(run).over(within))
    # Within a block: where the run of a row began (null in what may go on from the block before), and the turns since.
    cut = cut.withColumn("__began", F.max(F.when(change, place)).over(up_to))
    turn = (place == began) if not rows else (place - began) % rows == 0
    cut = stored(cut.withColumn("__turns", F.sum(F.coalesce(turn, F.lit(False)).cast("long")).over(up_to)), "segment-blocks")
    per = cut.groupBy(*keys).agg(F.count("*").alias("__n"), F.min_by(run, seq).alias("__run0"), F.max_by(run, seq).alias("__run1"), F.count_if(began.isNull()).alias("__first"), F.max("__turns").alias("__turned"), F.max("__began").alias("__last"))
    blocks = Window.partitionBy(series).orderBy("__block")  # one row a block
    earlier = blocks.rowsBetween(Window.unboundedPreceding, -1)
    total = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0).cast("long"))
    per = per.withColumn("__opens", (F.row_number().over(blocks) == 1) | ~F.col("__run0").eqNullSafe(F.lag("__run1").over(blocks))).withColumn("__before", total("__n"))
    per = per.withColumn("__start", F.when(F.col("__last").isNotNull(), F.col("__before") + F.col("__last")).when(opens, F.col("__before") + 1))
    per = per.withColumn("__offset", F.when(opens, 0).otherwise(F.col("__before") + 1 - F.max("__start").over(earlier)).cast("long"))

    def piece(n: Column) -> Column:
        """Turns in the first ``n`` rows of a block, as far as they go on from the block before."""
        if not rows:
            return opens.cast("long")
        return F.ceil((F.col("__offset") + n) / rows) - F.ceil(F.col("__offset") / rows)

    per = per.withColumn("__piece", F.when(F.col("__first") > 0, piece(F.col("__first"))).otherwise(F.lit(0)).cast("long"))
    per = per.withColumn("__carried", total(F.col("__piece") + F.col("__turned")))
    per = per.select(F.col(series).alias("__of"), F.col("__block").alias("__at"), "__opens", "__offset", "__piece", "__carried")
    out = cut.join(per, F.col(series).eqNullSafe(F.col("__of")) & F.col("__block").eqNullSafe(F.col("__at")))
    number = F.col("__carried") + F.when(began.isNull(), piece(place)).otherwise(F.col("__piece") + F.col("__turns"))
    return out.select(*names, number.cast("long").alias("segment"))


def with_aged_segments(df: DataFrame, seconds: float, time: str, rows: int | None = None, series: str = "series_id", run: str = "run_id", seq: str = "_seq", block: int = BLOCK) -> DataFrame:
    """``df`` with ``segment`` as :func:`with_segments` gives it, and a new one with each first row at which the open one is ``seconds`` old.

    Age is counted from a segment's first known time, by a clock that never goes back: the latest
    time of the run so far. Rows without a time end no segment. ``_seq`` is unique within a series.
    """
    names = [F.col(f"`{c}`") for c in df.columns]
    df = with_segments(df, rows, series, run, seq, block).withColumn("__micros", F.unix_micros(F.col(time).cast("timestamp"))).withColumn("__block", F.floor(F.col(seq) / block))
    keys = [series, "segment", "__block"]
    earlier = Window.partitionBy(series, "segment").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    up_to = Window.partitionBy(*keys).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    df = _carried(df, keys, {"__reached": F.max("__top").over(earlier)}, {"__top": F.max("__micros")})
    df = stored(df.withColumn("__clock", F.greatest(F.max("__micros").over(up_to), "__reached")).drop("__micros", "__reached"), "segment-clock")
    gap = round(seconds * 1_000_000)
    at = stored(df.where(F.col("__clock").isNotNull()).groupBy(F.col(series).alias("__of"), F.col("segment").alias("__in"), "__clock").agg(F.min(seq).alias("__open")), "segment-clocks")
    # A segment that never gets so old has no cut.
    old = at.groupBy(F.col("__of").alias("__s"), F.col("__in").alias("__g")).agg(F.min("__clock").alias("__began"), F.max("__clock").alias("__ended")).where(F.col("__ended") - F.col("__began") >= gap)
    at = stored(at.join(old, F.col("__of").eqNullSafe(F.col("__s")) & (F.col("__in") == F.col("__g"))).drop("__s", "__g", "__ended"), "segment-old")
    cuts = greedy(at, ["__of", "__in"], "__clock", gap).select(F.col("__of").alias("__s"), F.col("__in").alias("__g"), F.col("__clock").alias("__t"))
    cuts = at.where(F.col("__clock") > F.col("__began")).join(cuts, F.col("__of").eqNullSafe(F.col("__s")) & (F.col("__in") == F.col("__g")) & (F.col("__clock") == F.col("__t"))).select("__of", "__open")
    cuts = stored(cuts, "segment-cuts")
    df = df.join(cuts, F.col(series).eqNullSafe(F.col("__of")) & (F.col(seq) == F.col("__open")), "left").withColumn("__aged", F.col("__open").isNotNull().cast("long"))
    turned = F.coalesce(F.sum("__n").over(Window.partitionBy(series).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    df = _carried(df, [series, "__block"], {"__before": turned}, {"__n": F.sum("__aged")})
    within = Window.partitionBy(series, "__block").orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    return df.select(*names, (F.col("segment") + F.col("__before") + F.sum("__aged").over(within)).cast("long").alias("segment"))


def manifest(df: DataFrame, series: str = "series_id", run: str = "run_id", seq: str = "_seq") -> DataFrame:
    """One row per segment: its run, rows, and first and last place."""
    return df.groupBy(series, "segment").agg(F.min_by(run, seq).alias(run), F.count("*").alias("rows"), F.min(seq).alias("first_seq"), F.max(seq).alias("last_seq"))


def free_numbers(wanted: DataFrame, keys: list[str], order: str, taken: DataFrame | None = None) -> DataFrame:
    """``wanted`` with ``seq``: per key and in order, the first numbers from 1 on that ``taken`` (keys, seq) does not hold.

    The k-th free number is k plus the taken ones below it. A taken number t that has j smaller ones
    lies below all free numbers from the (t - j)-th on; so both kinds are put on one scale, and a
    running count along it is all that is needed. A key has as many rows as a day of a cell has files.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    if taken is None:
        return wanted.withColumn("seq", rank.cast("long"))
    held = taken.where("seq > 0").select(*keys, "seq").distinct()
    held = held.select(*keys, (F.col("seq") - F.row_number().over(Window.partitionBy(*keys).orderBy("seq")) + 1).alias("__rank"), F.lit(1).alias("__held"))
    both = wanted.withColumn("__rank", rank.cast("long")).unionByName(held, allowMissingColumns=True)
    scale = Window.partitionBy(*keys).orderBy(F.col("__rank"), F.col("__held").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("seq", (F.col("__rank") + F.coalesce(F.sum("__held").over(scale), F.lit(0))).cast("long"))
    return both.where(F.col("__held").isNull()).drop("__rank", "__held")


def numbered_files(segments: DataFrame, institution: str, day: Column, cell: str = "cell", order: str = "first_seq", taken: DataFrame | None = None) -> DataFrame:
    """``segments`` with ``seq`` and ``file``: per (cell without case, day), in order of arrival, the first numbers that are not ``taken``.

    ``taken`` has columns cell, day and seq; numbers run from 1, beyond 999 the name raises.
    """
    out = segments.withColumn("__day", day).withColumn("__cell", F.lower(cell))
    held = None if taken is None else taken.select(F.lower("cell").alias("__cell"), F.col("day").alias("__day"), F.col("seq").cast("long").alias("seq"))
    out = free_numbers(out, ["__cell", "__day"], order, held)
    return out.withColumn("file", text.dataset_filename(F.lit(institution), F.col(cell), F.col("__day"), F.col("seq"))).drop("__day", "__cell")


def cell_names(series: DataFrame, id_col: str = "series_id", seq: str = "first_seq") -> DataFrame:
    """``series`` (one row each) with ``cell``: safe names, unique without regard to case.

    The first to arrive keeps the plain name, later ones get a hash of their id; where that is
    taken too, a longer one. A null id is ``default``, which no literal id can take.
    """
    out = series.withColumn("__base", F.when(F.col(id_col).isNull(), DEFAULT).otherwise(text.cell_name(F.col(id_col))))
    first = F.row_number().over(Window.partitionBy(F.lower("__base")).orderBy(F.col(id_col).isNull().desc(), seq))
    reserved = (F.lower("__base") == DEFAULT) & F.col(id_col).isNotNull()
    out = out.withColumn("__plain", (first == 1) & ~reserved)
    digest = F.sha2(F.col(id_col), 256)
    for k, length in enumerate((8, 16, 32, 64)):
        named = F.when(F.col("__plain"), F.col("__base")).otherwise(F.concat("__base", F.lit("-"), F.substring(digest, 1, length)))
        before = F.col("cell") if k else None
        out = out.withColumn("cell", named if before is None else F.when(F.col("__again"), named).otherwise(before))
        clash = F.row_number().over(Window.partitionBy(F.lower("cell")).orderBy(F.col("__plain").desc(), seq)) > 1
        out = out.withColumn("__again", clash & ~F.col("__plain"))
    return out.drop("__base", "__plain", "__again")


def files_by_series(files: DataFrame, series: str = "series_id") -> DataFrame:
    """The files of each series in the order in which they were opened."""
    return files.groupBy(series).agg(F.transform(F.array_sort(F.collect_list(F.struct("segment", "file"))), lambda x: x.file).alias("files"))
