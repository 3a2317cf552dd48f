"""Greedy choices along an order: the first row of a group, then each first row that lies a gap beyond the last choice.

Such choices do not compose as sums. Every row gets a pointer to its successor, the row that would be
chosen after it: an as-of search by one sort. Rows are cut into blocks of their order, and within a
block pointers are doubled until they leave it. The rows that pointers enter blocks by are doubled
over blocks and marked from the first rows of the groups; each block is then followed from its marked
rows. Groups no larger than a block are followed at once. No other is one task, and rounds grow with the logarithm of the number of blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import stored

#: Rows of a block, as a power of two within the 33 bits that the numbers of a partition's rows have; what stands for no row.
BITS, NONE = 16, -1


def numbered(nodes: DataFrame, keys: list[str], at: str) -> DataFrame:
    """(keys, at, id, g): ids ascend by keys and place; g is the id of the group's first row. Distinct places of a group are one row each."""
    order = [*keys, at]
    rows = nodes.select(*order).distinct().repartitionByRange(*order).sortWithinPartitions(*order)
    rows = stored(rows.withColumn("id", F.monotonically_increasing_id()), "greedy-rows")
    first = rows.groupBy(*keys).agg(F.min("id").alias("g")).select(*(F.col(k).alias(f"__{i}") for i, k in enumerate(keys)), "g")
    same = [F.col(k).eqNullSafe(F.col(f"__{i}")) for i, k in enumerate(keys)]
    return rows.join(first, same).drop(*(f"__{i}" for i in range(len(keys))))


def _searched(before: dict[int, tuple[int, int]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Ranges of rows come backwards; a query's successor is the last node before it in its group.

    ``before`` has, for each range, the group and the node that earlier ranges end with.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, group, node = None, None, NONE
        for batch in batches:
            parts = batch.column("part").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(parts)]
            for first, end in zip(cuts, cuts[1:], strict=False):
                if first == end:
                    continue
                if parts[first] != part:
                    part = int(parts[first])
                    group, node = before.get(part, (None, NONE))
                piece = batch.slice(first, end - first)
                g, ids = piece.column("g").to_numpy(), piece.column("id").to_numpy()
                query = piece.column("query").to_numpy(zero_copy_only=False)
                place = np.arange(len(g))
                seen = np.maximum.accumulate(np.where(query, NONE, place))
                began = np.maximum.accumulate(np.where(np.append(g[0] != group, g[1:] != g[:-1]), place, NONE))
                own = seen >= np.maximum(began, 0)
                succ = np.where(own, ids[np.maximum(seen, 0)], np.where(began < 0, node, NONE))
                group, node = int(g[-1]), int(succ[-1])
                yield pa.RecordBatch.from_arrays([pa.array(x[query]) for x in (ids, g, succ)], names=["id", "g", "succ"])

    return run


def successors(rows: DataFrame, gap: int) -> DataFrame:
    """(id, g, succ) of every row (id, g, at): the first row of its group at ``at + gap`` or beyond; -1 where there is none."""
    node = rows.select("id", "g", "at", F.lit(False).alias("query"))
    both = node.unionByName(node.withColumn("at", F.col("at") + gap).withColumn("query", F.lit(True)))
    order = [F.desc("g"), F.desc("at"), F.asc("query")]
    both = stored(both.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()), "greedy-order")
    last = both.groupBy("part").agg(F.min(F.struct("g", "query", "at", "id")).alias("x")).orderBy("part").collect()  # one row a range
    before, group, found = {}, None, NONE
    for r in last:
        before[r.part] = (group, found)
        if not r.x.query:
            group, found = r.x.g, r.x.id
        elif r.x.g != group:
            group, found = r.x.g, NONE
    return both.repartition("part").sortWithinPartitions("part", *order).mapInArrow(_searched(before), "id long, g long, succ long")


def _block(c: Column) -> Column:
    return F.shiftright(c, BITS)


def _left(group: pa.Table) -> pa.Table:
    """Where each row's pointers lead to when they leave the block; -1 where they end in it."""
    group = group.sort_by("id")
    ids, out = group.column("id").to_numpy(), group.column("succ").to_numpy().copy()
    last = ids[-1]
    while len(inside := np.flatnonzero((out != NONE) & (out <= last))):
        out[inside] = out[np.searchsorted(ids, out[inside])]
    return pa.table({"id": ids, "exit": out})


def _followed(group: pa.Table, entries: pa.Table) -> pa.Table:
    """The rows of a block that are met from its entries."""
    group = group.sort_by("id")
    ids, succ = group.column("id").to_numpy(), group.column("succ").to_numpy()
    met = []
    for at in entries.column("entry").to_pylist():
        while at != NONE and at <= ids[-1]:
            met.append(at)
            at = int(succ[np.searchsorted(ids, at)])
    return pa.table({"id": pa.array(met, pa.int64())})


def chosen(rows: DataFrame, gap: int) -> DataFrame:
    """(id) of the rows (id, g, at) that are chosen: the first of each group, then each first one ``gap`` beyond the last choice.

    ``gap`` is positive. Ids ascend with groups and places, as :func:`numbered` gives them.
    """
    links = stored(successors(rows, gap), "greedy-links")
    exits = stored(links.groupBy(_block(F.col("id")).alias("b")).applyInArrow(_left, "id long, exit long"), "greedy-exits")
    starts = links.select(F.col("g").alias("entry")).distinct()
    entered = exits.where(F.col("exit") != NONE).select(F.col("exit").alias("entry")).distinct().union(starts).distinct()
    jump = stored(exits.join(entered, exits["id"] == entered["entry"], "left_semi").where(F.col("exit") != NONE).select(F.col("id").alias("a"), F.col("exit").alias("z")), "greedy-jumps")
    marked = starts
    while jump.limit(1).count():
        # Marks reach 2^k blocks; a jump goes over as many.
        marked = stored(marked.union(marked.join(jump, marked["entry"] == jump["a"]).select("z")).distinct(), "greedy-marks")
        second = jump.select(F.col("a").alias("m"), F.col("z").alias("y"))
        jump = stored(jump.join(second, jump["z"] == second["m"]).select("a", F.col("y").alias("z")), "greedy-jumps")
    left, right = links.groupBy(_block(F.col("id")).alias("b")), marked.groupBy(_block(F.col("entry")).alias("b"))
    return left.cogroup(right).applyInArrow(_followed, "id long")


def _scanned(keys: list[str], at: str, gap: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The chosen rows of groups that come whole and in order, one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        due = 0
        for batch in batches:
            met = []
            for k, (new, place) in enumerate(zip(batch.column("__new").to_pylist(), batch.column(at).to_pylist(), strict=True)):
                if new or place >= due:
                    met.append(k)
                    due = place + gap
            yield batch.take(pa.array(met, pa.int64())).select([*keys, at])

    return run


def greedy(nodes: DataFrame, keys: list[str], at: str, gap: int) -> DataFrame:
    """(keys, at) of the chosen places of ``nodes``, where ``at`` is a whole number that is not null.

    Groups that are no larger than a block are read once from end to end, many in a task; only larger ones need pointers.
    """
    nodes = stored(nodes.select(*keys, at), "greedy-places")
    large = nodes.groupBy(*keys).count().where(F.col("count") > 1 << BITS).drop("count")
    large = stored(large.select(*(F.col(k).alias(f"__{i}") for i, k in enumerate(keys))), "greedy-large")  # one row for so many places
    same = [F.col(k).eqNullSafe(F.col(f"__{i}")) for i, k in enumerate(keys)]
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(at)) == 1
    small = nodes.join(large, same, "left_anti").select(*keys, at, first.alias("__new"))
    found = small.mapInArrow(_scanned(keys, at, gap), nodes.schema)
    if not large.limit(1).count():
        return found
    rows = stored(numbered(nodes.join(large, same, "left_semi"), keys, at), "greedy-nodes")
    picked = chosen(rows.select("id", "g", F.col(at).alias("at")), gap)
    return found.union(rows.join(picked, "id", "left_semi").select(*keys, at))
