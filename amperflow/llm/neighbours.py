"""Approximate nearest neighbours: NN-descent by Spark joins, and greedy search of its graph.

Equal vectors become one node that knows its 11 smallest ids (more can be in no answer of 10), so a
vector in a third of all rows is one node. A first graph comes from blocks of nodes that lie on the
same sides of some planes, in several tables of planes. Each round then joins every node's
neighbours, forward and backward, with their vectors; within such a neighbourhood all pairs are
measured, and pairs nearer than what their ends have yet become edges. Rounds end when few edges
change. A search has one row per query vector: its nearest nodes so far, at most ``BEAM``, which of
them are open, and the ids it has met. Each hop expands the nearest open ones; a search ends when it
has none, however many hops that takes, and leaves the loop.

Lists of a node (ids, distances, flags) are packed in one binary value each, so that a node is one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_written, table, written

K, BACK = 32, 16  # edges of a node; backward neighbours that take part in its joins
BLOCK, TABLES, EACH = 2048, 12, 16  # nodes measured against each other at first, in so many tables; edges that a table gives a node
STOP = 0.005  # rounds end when a smaller share of edges is fresh
TOP, BEAM, WIDTH = 10, 96, 32
SAMPLE = 1024  # vectors that set centre, scale and planes
QUERY_EVERY = 100
FAR = 1e15  # scaled components end here: squares stay finite in single precision
NODE = "id long, vec binary, near binary, dist binary, fresh binary, n_fresh int"


def usable(rows: DataFrame) -> DataFrame:
    """vec_id, embedding (array of double) of rows that take part: finite, not all zero, of the commonest length, with an id."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("embedding")).where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(fine, F.lit(False)))
    common = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("embedding") == (common["n"] if common else 0))


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two arrays of double."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, x: acc + x))


def _rows(column: pa.Array, kind) -> np.ndarray:
    """A matrix from a column of packed lists of one length."""
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1)


def _packed(x: np.ndarray) -> pa.Array:
    """A column of packed rows of a matrix."""
    x = np.ascontiguousarray(x)
    size = x.shape[1] * x.itemsize
    ends = np.arange(len(x) + 1, dtype=np.int32) * size
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(ends), pa.py_buffer(x.tobytes())])


def _squares(x: np.ndarray) -> np.ndarray:
    """Squared distances within each matrix of a stack."""
    n = (x * x).sum(axis=2)
    return np.maximum(n[:, :, None] + n[:, None, :] - 2 * (x @ x.transpose(0, 2, 1)), 0)


def _starts(key: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)


def _ranks(key: np.ndarray) -> np.ndarray:
    """Place of each row within its run of equal keys."""
    first = _starts(key)
    return np.arange(len(key)) - np.repeat(first, np.diff(np.append(first, len(key))))


def _lists(p: np.ndarray, q: np.ndarray, d: np.ndarray, most: int) -> pa.RecordBatch | None:
    """Packed lists (id, near, dist) of the ``most`` nearest q of each p."""
    if not len(p):
        return None
    order = np.lexsort((d, q, p))
    p, q, d = p[order], q[order], d[order]
    once = np.append(True, (p[1:] != p[:-1]) | (q[1:] != q[:-1]))
    p, q, d = p[once], q[once], d[once]
    order = np.lexsort((q, d, p))
    p, q, d = p[order], q[order], d[order]
    rank = _ranks(p)
    keep = rank < most
    p, q, d = p[keep], q[keep], d[keep].astype(np.float32)
    ends = np.append(_starts(p), len(p)).astype(np.int32)
    cut = lambda x: pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends * np.int32(x.itemsize)), pa.py_buffer(x.tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(p[ends[:-1]]), cut(q), cut(d)], names=["id", "near", "dist"])


def block_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of each node's nearest of its block, over rows (t, id, vec) in order of table and place."""
    held, of = [], None

    def flush(ids: np.ndarray, x: np.ndarray) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(ids), BLOCK):
            a = min(a, max(0, len(ids) - BLOCK))  # the last block is a whole one where it can be
            own, d = ids[a : a + BLOCK], _squares(x[None, a : a + BLOCK])[0]
            np.fill_diagonal(d, np.inf)
            k = min(EACH, len(own) - 1)
            if k > 0:
                near = np.argpartition(d, k - 1, axis=1)[:, :k]
                yield pa.RecordBatch.from_arrays([pa.array(own), _packed(own[near]), _packed(np.sqrt(np.take_along_axis(d, near, 1)).astype(np.float32))], names=["id", "near", "dist"])

    def rest() -> Iterator[pa.RecordBatch]:
        if held:
            yield from flush(*(np.concatenate(z) for z in zip(*held, strict=True)))

    for batch in batches:
        t, ids, x = batch.column("t").to_numpy(), batch.column("id").to_numpy(), _rows(batch.column("vec"), np.float32)
        for a, b in zip(first := _starts(t).tolist(), [*first[1:], len(t)], strict=True):
            if t[a] != of:
                yield from rest()
                held, of = [], t[a]
            held.append((ids[a:b], x[a:b]))
            if sum(len(h[0]) for h in held) >= 8 * BLOCK:
                yield from rest()
                held = []
    yield from rest()


def merge_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row of a node's K nearest from its own row (vec not null) and lists found, over rows sorted by id.

    What a node had already is not fresh. A group is bounded: a node has one row, and one list of each
    table or batch of neighbourhoods that found something.
    """

    def merged(rows: pa.Table) -> pa.RecordBatch:
        ids = rows.column("id").to_numpy()
        sizes = np.array([len(x) // 8 if x else 0 for x in rows.column("near").to_pylist()])
        own = np.array([x is not None for x in rows.column("vec").to_pylist()])
        p = np.repeat(ids, sizes)
        q = np.frombuffer(b"".join(x for x in rows.column("near").to_pylist() if x), np.int64)
        d = np.frombuffer(b"".join(x for x in rows.column("dist").to_pylist() if x), np.float32)
        new = ~np.repeat(own, sizes)
        real = q != p
        p, q, d, new = p[real], q[real], d[real], new[real]
        order = np.lexsort((new, q, p))  # an edge that was there before comes first
        p, q, d, new = p[order], q[order], d[order], new[order]
        once = np.append(True, (p[1:] != p[:-1]) | (q[1:] != q[:-1])) if len(p) else np.empty(0, bool)
        p, q, d, new = p[once], q[once], d[once], new[once]
        order = np.lexsort((q, d, p))
        p, q, d, new = p[order], q[order], d[order], new[order]
        rank = _ranks(p)
        keep = (rank < K) & np.isfinite(d)
        p, q, d, new, rank = p[keep], q[keep], d[keep], new[keep], rank[keep]
        node = ids[own]
        at = np.searchsorted(node, p)
        near, dist, fresh = np.repeat(node, K).reshape(-1, K), np.full((len(node), K), np.inf, np.float32), np.zeros((len(node), K), np.uint8)
        near[at, rank], dist[at, rank], fresh[at, rank] = q, d, new
        vec = rows.column("vec").combine_chunks().filter(pa.array(own))
        return pa.RecordBatch.from_arrays([pa.array(node), vec, _packed(near), _packed(dist), _packed(fresh), pa.array(fresh.sum(axis=1).astype(np.int32))], names=["id", "vec", "near", "dist", "fresh", "n_fresh"])

    for rows in whole_groups(batches, "id"):
        yield merged(rows)


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows, sorted by ``key``, in pieces that split no key."""
    carry = None
    for batch in batches:
        if not batch.num_rows:
            continue
        part = pa.Table.from_batches([batch])
        part = pa.concat_tables([carry, part]) if carry is not None else part
        keys = part.column(key).to_numpy()
        last = int(np.searchsorted(keys, keys[-1]))
        carry = part.slice(last)
        if last:
            yield part.slice(0, last).combine_chunks()
    if carry is not None:
        yield carry.combine_chunks()


def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (u, v, fresh, d) of all edges of nodes."""
    for batch in batches:
        near, dist, fresh = _rows(batch.column("near"), np.int64), _rows(batch.column("dist"), np.float32), _rows(batch.column("fresh"), np.uint8)
        real = np.isfinite(dist)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("id").to_numpy(), real.sum(axis=1))), pa.array(near[real]), pa.array(fresh[real] > 0), pa.array(dist[real])], names=["u", "v", "fresh", "d"])


def reaches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (v, vec, reach): how near a node must be to get into the list of v."""
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("vec"), pa.array(_rows(batch.column("dist"), np.float32)[:, K - 1].copy())], names=["v", "vec", "reach"])


def join_neighbourhoods(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of neighbours of one node that are nearer to each other than what one of them has yet.

    Rows (u, v, fresh, reach, vec) come sorted by u; a node has at most K + BACK of them. Pairs of
    which neither is fresh were measured in an earlier round.
    """
    most = K + BACK
    for rows in whole_groups(batches, "u"):
        u, v, fresh, reach = rows.column("u").to_numpy(), rows.column("v").to_numpy(), np.asarray(rows.column("fresh")).astype(bool), rows.column("reach").to_numpy()
        x, start = _rows(rows.column("vec"), np.float32), _starts(u)
        length, found = np.diff(np.append(start, len(u))), []
        for a in range(0, len(start), 256):
            s, n = start[a : a + 256], length[a : a + 256]
            at = np.minimum(s[:, None] + np.arange(most), len(u) - 1)
            real = np.arange(most) < n[:, None]
            d = np.sqrt(_squares(x[at]))
            ok = real[:, :, None] & real[:, None, :] & (fresh[at][:, :, None] | fresh[at][:, None, :]) & (d < reach[at][:, :, None]) & (v[at][:, :, None] != v[at][:, None, :])
            g, i, j = np.nonzero(ok)
            found.append((v[at[g, i]], v[at[g, j]], d[g, i, j]))
        if (out := _lists(*(np.concatenate(z) for z in zip(*found, strict=True)), K)) is not None:
            yield out


def singles(nodes: DataFrame) -> DataFrame:
    """id, vec: vectors in single precision, centred and scaled by medians of a bounded sample of them.

    No one vector sets the scale, and a common offset takes no precision.
    """
    seen = nodes.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
    known = np.array([r["embedding"] for r in seen], np.float64)
    centre = np.median(known, axis=0) if len(known) else np.zeros(1)
    with np.errstate(over="ignore"):
        largest = np.abs(known - centre).max(axis=1) if len(known) else np.ones(1)
    scale = float(np.median(largest)) or float(largest.max()) or 1.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column("embedding").to_pylist(), np.float64).reshape(batch.num_rows, -1)
            with np.errstate(over="ignore"):
                x = np.clip((x - centre[: x.shape[1]]) / scale, -FAR, FAR).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column("id"), _packed(x)], names=["id", "vec"])

    return nodes.select("id", "embedding").mapInArrow(run, "id long, vec binary")


def neighbour_graph(nodes: DataFrame) -> DataFrame:
    """NODE rows of nodes (id, embedding): the packed lists of about the K nearest nodes of each.

    ``near`` is padded with the node's own id and ``dist`` with infinity; distances are those of scaled vectors.
    The table returned is written; whoever has read it drops it.
    """
    small = written(singles(nodes), "singles")
    n = small.count()
    bits = max(0, int(np.ceil(np.log2(max(n, 1) / BLOCK))))
    # Planes half-way between sampled nodes: a bounded sample, by hash.
    sample = [np.frombuffer(r.vec, np.float32) for r in small.orderBy(F.xxhash64("id", F.lit(1)), "id").limit(2 * TABLES * (bits + 1)).collect()]
    size = len(sample[0]) if sample else 1
    rng = np.random.default_rng(3)
    normals, offsets = [], []
    for _ in range(TABLES):
        pairs = [rng.choice(len(sample), 2, replace=False) for _ in range(bits + 1)] if len(sample) > 1 else []
        normal = np.array([sample[a] - sample[b] for a, b in pairs], np.float32).reshape(-1, size)
        middle = np.array([(sample[a] + sample[b]) / 2 for a, b in pairs], np.float32).reshape(-1, size)
        normals.append(normal)
        offsets.append((normal * middle).sum(axis=1))

    def sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _rows(batch.column("vec"), np.float32)
            for t, (normal, offset) in enumerate(zip(normals, offsets, strict=True)):
                along = x @ normal.T - offset if len(normal) else np.zeros((len(x), 1), np.float32)
                code = (along[:, 1:] > 0) @ (1 << np.arange(along.shape[1] - 1, dtype=np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), pa.array(code.astype(np.int64)), pa.array(along[:, 0], pa.float32()), batch.column("id"), batch.column("vec")], names=["t", "code", "rest", "id", "vec"])

    dealt = small.mapInArrow(sides, "t int, code long, rest float, id long, vec binary")
    place = ("t", "code", "rest", "id")
    dealt = dealt.repartitionByRange(max(1, n * TABLES // (16 * BLOCK)), *place).sortWithinPartitions(*place)
    found = dealt.select("t", "id", "vec").mapInArrow(block_edges, "id long, near binary, dist binary")

    def merged(known: DataFrame, found: DataFrame) -> DataFrame:
        rows = known.select("id", "vec", "near", "dist").unionByName(found.select("id", F.lit(None).cast("binary").alias("vec"), "near", "dist"))
        return written(rows.repartition("id").sortWithinPartitions("id").mapInArrow(merge_lists, NODE), "graph")

    none = F.lit(None).cast("binary")
    graph = merged(small.select("id", "vec", none.alias("near"), none.alias("dist")), found)
    drop_written(small)
    while True:
        edges, fresh = graph.agg(F.count("*") * K, F.sum("n_fresh")).first()
        if not fresh or fresh <= STOP * edges:
            return graph
        lines = graph.mapInArrow(spread, "u long, v long, fresh boolean, d float")
        last = Window.partitionBy("u").orderBy("d", "v")
        back = lines.select(F.col("v").alias("u"), F.col("u").alias("v"), "fresh", "d").withColumn("__n", F.row_number().over(last)).where(F.col("__n") <= BACK)
        around = lines.select("u", "v", "fresh").union(back.select("u", "v", "fresh")).groupBy("u", "v").agg(F.max("fresh").alias("fresh"))
        info = graph.mapInArrow(reaches, "v long, vec binary, reach float")
        around = around.join(info, "v").select("u", "v", "fresh", "reach", "vec")
        found = around.repartition("u").sortWithinPartitions("u").mapInArrow(join_neighbourhoods, "id long, near binary, dist binary")
        after = merged(graph, found)
        drop_written(graph)
        graph = after


STATE = "home long, vec binary, ids binary, dist binary, open binary, near binary, seen binary, n_open int"


def _frontier(is_open: np.ndarray, near: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of a search's nearest open nodes, and their neighbours that it has not met."""
    go = np.flatnonzero(is_open)[:WIDTH]
    met = np.unique(near[go])
    return go, np.setdiff1d(met, seen, assume_unique=True)


def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (home, node): the nodes that each search meets next."""
    for batch in batches:
        homes, nodes = [], []
        for home, is_open, near, seen in zip(batch.column("home").to_pylist(), *(batch.column(c).to_pylist() for c in ("open", "near", "seen")), strict=True):
            _, new = _frontier(np.frombuffer(is_open, np.uint8), np.frombuffer(near, np.int64).reshape(-1, K), np.frombuffer(seen, np.int64))
            homes.append(np.full(len(new), home, np.int64))
            nodes.append(new)
        if homes:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(homes)), pa.array(np.concatenate(nodes))], names=["home", "node"])


def advance(beam: int):
    """A step of all searches, over rows sorted by home: first a search's own row (seen not null), then the nodes it met (node, vec, near)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, "home"):
            home = rows.column("home").to_numpy()
            column = {c: rows.column(c).combine_chunks() for c in ("vec", "ids", "dist", "open", "near", "seen", "node")}
            out: list[tuple] = []
            for a, b in zip(first := _starts(home).tolist(), [*first[1:], len(home)], strict=True):
                read = lambda c, kind, at=a: np.frombuffer(column[c][at].as_py(), kind)
                vec, ids, dist, is_open, near, seen = read("vec", np.float32), read("ids", np.int64), read("dist", np.float32), read("open", np.uint8).copy(), read("near", np.int64).reshape(-1, K), read("seen", np.int64)
                go, new = _frontier(is_open, near, seen)
                is_open[go] = 0
                if b > a + 1:
                    met = column["node"].slice(a + 1, b - a - 1).to_numpy(zero_copy_only=False).astype(np.int64)
                    x = _rows(column["vec"].slice(a + 1, b - a - 1), np.float32)
                    far = np.sqrt(((x - vec) ** 2).sum(axis=1, dtype=np.float64)).astype(np.float32)
                    ids, dist = np.concatenate([ids, met]), np.concatenate([dist, far])
                    is_open = np.concatenate([is_open, np.ones(len(met), np.uint8)])
                    near = np.concatenate([near, _rows(column["near"].slice(a + 1, b - a - 1), np.int64)])
                best = np.lexsort((ids, dist))[:beam]
                out.append((home[a], vec.tobytes(), ids[best].tobytes(), dist[best].tobytes(), is_open[best].tobytes(), near[best].tobytes(), np.union1d(seen, new).tobytes(), int(is_open[best].sum())))
            parts = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(parts[0], pa.int64()), *(pa.array(p, pa.binary()) for p in parts[1:7]), pa.array(parts[7], pa.int32())], names=["home", "vec", "ids", "dist", "open", "near", "seen", "n_open"])

    return run


def met_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (home, node) of the nodes that searches end with."""
    for batch in batches:
        ids = [np.frombuffer(x, np.int64) for x in batch.column("ids").to_pylist()]
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("home").to_numpy(), [len(x) for x in ids])), pa.array(np.concatenate(ids))], names=["home", "node"])


def greedy(graph: DataFrame, homes: DataFrame, beam: int = BEAM) -> DataFrame:
    """(home, node): what a greedy search of ``graph`` (NODE rows) from each node of ``homes`` (home) ends with.

    A hop joins only what searches meet next. Searches without an open node among their ``beam``
    nearest are over and take no further part.
    """
    points = graph.select("id", "vec", "near")
    begin = homes.join(points, F.col("home") == F.col("id")).select("home", "vec", "near")

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.int64(x).tobytes() for x in batch.column("home").to_pylist()]
            n = len(own)
            yield pa.RecordBatch.from_arrays([batch.column("home"), batch.column("vec"), pa.array(own, pa.binary()), _packed(np.zeros((n, 1), np.float32)), _packed(np.ones((n, 1), np.uint8)), batch.column("near"), pa.array(own, pa.binary()), pa.array(np.ones(n, np.int32))], names=["home", "vec", "ids", "dist", "open", "near", "seen", "n_open"])

    state = written(begin.mapInArrow(start, STATE), "searches")
    over = []
    while True:
        over.append(state.where("n_open = 0").select("home", "ids"))
        live = state.where("n_open > 0")
        if not live.limit(1).count():
            break
        asks = live.select("home", "open", "near", "seen").mapInArrow(expand, "home long, node long")
        met = asks.join(points, F.col("node") == F.col("id")).select("home", "node", "vec", "near")
        null = F.lit(None)
        rows = live.select("home", null.cast("long").alias("node"), "vec", "near", "ids", "dist", "open", "seen")
        rows = rows.unionByName(met.select("home", "node", "vec", "near", *(null.cast("binary").alias(c) for c in ("ids", "dist", "open", "seen"))))
        state = written(rows.repartition("home").sortWithinPartitions("home", F.col("node").asc_nulls_first()).mapInArrow(advance(beam), STATE), "searches")
    out = over[0]
    for part in over[1:]:
        out = out.union(part)
    return out.mapInArrow(met_nodes, "home long, node long")


def search(rows: DataFrame, queries: Column, top: int = TOP) -> DataFrame:
    """query_id, rank, vec_id, score: the ``top`` nearest found of every row for which ``queries`` holds.

    Rows that cannot take part (see :func:`usable`) are neither queries nor answers; a query never
    finds its own row, though rows of the same vector, at distance 0. Ties go to the smaller
    vec_id. A vec_id that occurs on several rows stands for each of its vectors. Queries of one
    vector are one search. An empty table gives no rows; other columns are not read.
    """
    fine = usable(rows)
    ranked = fine.distinct().withColumn("__n", F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))).where(F.col("__n") <= top + 1)
    classes = ranked.groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("members"))
    # A class is known by a hash of its vector: ids of rows may repeat.
    nodes = written(classes.select(F.xxhash64("embedding").alias("id"), "embedding", "members"), "nodes")
    asked = fine.where(queries).select(F.col("vec_id").alias("query"), F.xxhash64("embedding").alias("home")).distinct()
    homes = written(asked.select("home").distinct(), "homes")
    graph = neighbour_graph(nodes)
    found = written(greedy(graph, homes, max(BEAM, 4 * (top + 1))), "found")
    drop_written(graph)
    x = nodes.select(F.col("id").alias("node"), F.col("embedding").alias("x"), "members")
    q = homes.join(nodes.select(F.col("id").alias("home"), F.col("embedding").alias("q")), "home")
    measured = found.join(x, "node").join(q, "home").select("home", distance(F.col("q"), F.col("x")).alias("score"), F.explode("members").alias("vec_id"))
    measured = measured.groupBy("home", "vec_id").agg(F.min("score").alias("score"))
    # Of one more than ``top``, each query leaves out its own row.
    place = F.row_number().over(Window.partitionBy("home").orderBy("score", "vec_id"))
    best = measured.withColumn("__n", place).where(F.col("__n") <= top + 1).groupBy("home").agg(F.array_sort(F.collect_list(F.struct("score", "vec_id"))).alias("best"))
    own = asked.join(best, "home").select("query", F.slice(F.filter("best", lambda y: y.vec_id != F.col("query")), 1, top).alias("best"))
    own = own.select("query", F.posexplode("best").alias("place", "y"))
    return own.select(F.col("query").alias("query_id"), (F.col("place") + 1).cast("int").alias("rank"), F.col("y.vec_id").alias("vec_id"), F.col("y.score").alias("score"))


def op6_descent_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of every row of ``embeddings`` whose vec_id is divisible by 100; see :func:`search`."""
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % QUERY_EVERY == 0)


ORACLE = r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pair AS (SELECT q.vec_id AS query_id, x.vec_id, sqrt(list_reduce(list_prepend(0.0::DOUBLE, list_transform(list_zip(q.e, x.e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), lambda a, b: a + b)) AS score FROM v q JOIN v x ON q.vec_id <> x.vec_id AND len(q.e) = len(x.e) WHERE q.vec_id % 100 = 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM pair)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM placed WHERE rank <= 10
"""
