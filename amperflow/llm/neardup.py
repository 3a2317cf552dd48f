"""MinHash near-dedup: circulant MinHash, banding, exact verification, components.

1. One pass over the texts gives, per document, the size of its shingle set, a digest of the set
   (equal sets become one node), the band keys of its circulant MinHash signature, and a parity
   bitmap of the set (1,024 bits, each hash flips one).
2. Nodes that share a band key form a bucket. First every node is compared with each of its buckets'
   least node; verified links are merged into components.
3. Then, in buckets that still hold several components, nodes outside the bucket's main component
   meet all nodes of other components. The bitmaps prune without loss: the bits that differ are at
   most as many as the hashes that differ, so a pair with more than (m + n) / 9 differing bits
   cannot reach 0.8. What remains is verified on full sets.
Pairs inside a component need no comparison, so a group of copies costs one comparison per member.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_slices, drop_written, table, written
from .components import components
from .neardup_features import BANDS, bands_of
from .shingles import mix, shingle_hashes

NUM, DEN = 80, 100  # link where DEN * intersection >= NUM * union
LONGS, SIDE = 16, 256


def digests(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One 64-bit digest per non-empty set, by sums of two keyed permutations of its hashes."""
    one = np.add.reduceat(mix(hashes + np.uint64(1)), bounds[:-1])
    two = np.add.reduceat(mix(hashes ^ np.uint64(0x5851F42D4C957F2D)), bounds[:-1])
    return mix(one + mix(two) + np.diff(bounds).astype(np.uint64)).view(np.int64)


def parities(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Parity bitmaps (sets x 16 longs): each hash flips the bit that its ten lowest mixed bits name."""
    at = (mix(hashes ^ np.uint64(0xDA942042E4DD58B5)) & np.uint64(64 * LONGS - 1)).astype(np.int64)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    bits = np.bincount(row * 64 * LONGS + at, minlength=(len(bounds) - 1) * 64 * LONGS) & 1
    return np.packbits(bits.astype(np.uint8).reshape(-1, 64 * LONGS), axis=1, bitorder="little").view("<i8")


def features(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, n_shingles, node (null where the set is empty), bands, parity: one row per row."""
    schema = "doc_id long, key long, n_shingles long, node long, bands array<long>, parity array<long>"

    def lists(x: np.ndarray, where: np.ndarray) -> pa.Array:
        ends = np.concatenate([[0], np.cumsum(where * x.shape[1])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(x.reshape(-1), pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, ends in byte_slices(batch.column("text"), 1 << 20):
                hashes, bounds = shingle_hashes(data, ends, n)
                size = np.diff(bounds)
                some = size > 0
                own = np.append(bounds[:-1][some], bounds[-1])
                node = np.zeros(len(size), np.int64)
                if some.any():
                    node[some] = digests(hashes, own)
                    bands, parity = bands_of(hashes, own), parities(hashes, own)
                else:
                    bands, parity = np.empty((0, BANDS), np.int64), np.empty((0, LONGS), np.int64)
                part = batch.slice(first, end - first)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), part.column("key"), pa.array(size, pa.int64()), pa.array(node, mask=~some), lists(bands, some), lists(parity, some)],
                    names=["doc_id", "key", "n_shingles", "node", "bands", "parity"],
                )

    return docs.select("doc_id", F.xxhash64("text").alias("key"), "text").mapInArrow(run, schema)


def sets_of(docs: DataFrame, n: int) -> DataFrame:
    """node, hashes (the full set, ascending) of every row with a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, ends in byte_slices(batch.column("text"), 1 << 20):
                hashes, bounds = shingle_hashes(data, ends, n)
                some = np.diff(bounds) > 0
                if some.any():
                    own = np.append(bounds[:-1][some], bounds[-1])
                    yield pa.RecordBatch.from_arrays([pa.array(digests(hashes, own)), pa.ListArray.from_arrays(pa.array(own.astype(np.int32)), pa.array(hashes.view(np.int64)))], names=["node", "hashes"])

    return docs.select("text").mapInArrow(run, "node long, hashes array<long>")


def may_link(x: str, y: str) -> Column:
    """Whether sizes and parity bitmaps of two nodes allow a similarity of 0.8; never false for a link."""
    m, n = F.col(f"{x}.n_shingles"), F.col(f"{y}.n_shingles")
    apart = sum((F.bit_count(F.get(F.col(f"{x}.parity"), k).bitwiseXOR(F.get(F.col(f"{y}.parity"), k))) for k in range(LONGS)), F.lit(0))
    return (F.least(m, n) * DEN >= F.greatest(m, n) * NUM) & (apart * (DEN + NUM) <= (m + n) * (DEN - NUM))


def first_met(x: str, y: str) -> Column:
    """Whether two members of a bucket share no earlier one: a pair is told by its first bucket alone."""
    band = F.col(f"{x}.band")
    return reduce(and_, ((band <= k) | (F.get(F.col(f"{x}.bands"), k) != F.get(F.col(f"{y}.bands"), k)) for k in range(BANDS)))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose full sets reach the similarity."""
    left = sets.select(F.col("node").alias("a"), F.col("hashes").alias("ha"))
    right = sets.select(F.col("node").alias("b"), F.col("hashes").alias("hb"))
    both = pairs.join(left, "a").join(right, "b").withColumn("common", F.size(F.array_intersect("ha", "hb")))
    return both.where(F.col("common") * DEN >= (F.size("ha") + F.size("hb") - F.col("common")) * NUM).select("a", "b")


def assign_groups(docs: DataFrame, n: int = 4) -> DataFrame:
    """doc_id, key, n_shingles, component_id, kept for every row of ``docs``.

    ``component_id`` is the smallest doc_id of the group; a text without words (null and empty
    ones too) is a group of its own; null doc_ids are never the smallest (a group of nothing else
    has a null one and ``kept`` false). Equal rows get equal results. ``key`` is a hash of the text.
    """
    rows = written(features(docs, n), "features")
    nodes = rows.where("node is not null").groupBy("node").agg(
        F.min("doc_id").alias("least"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("parity").alias("parity"), F.min_by("key", F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("key")
    )
    nodes = written(nodes, "nodes")
    member = nodes.select("node", F.posexplode("bands").alias("band", "value"))
    shared = member.groupBy("band", "value").agg(F.min("node").alias("lead"), F.count("*").alias("size")).where("size > 1").drop("size")
    member = written(member.join(shared, ["band", "value"]), "buckets")
    info = nodes.join(member.select("node").distinct(), "node", "left_semi").select("node", "least", "key", "n_shingles", "parity", "bands")
    info = written(info, "candidates")

    # The full sets of nodes with a companion, from one document each (of a null doc_id where there is no other).
    told = info.select(F.col("least").alias("__least"), F.col("key").alias("__told"))
    one = docs.select("doc_id", F.xxhash64("text").alias("__key"), "text").join(told, F.col("doc_id").eqNullSafe(F.col("__least")) & (F.col("__key") == F.col("__told")), "left_semi")
    sets = written(sets_of(one, n).dropDuplicates(["node"]), "sets")

    stars = member.where("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct()
    x, y = info.alias("x"), info.alias("y")
    stars = stars.join(x, F.col("a") == F.col("x.node")).join(y, (F.col("b") == F.col("y.node")) & may_link("x", "y")).select("a", "b")
    links = written(verified(stars, sets), "links")
    roots = components(links)

    # Buckets that still hold several components.
    held = member.join(roots, "node", "left").select("band", "value", "node", F.coalesce("root", "node").alias("root"))
    held = written(held, "held")
    parts = held.groupBy("band", "value", "root").agg(F.count("*").alias("size"))
    main = parts.groupBy("band", "value").agg(F.count("*").alias("parts"), F.max(F.struct("size", "root")).alias("main"), F.sum("size").alias("members")).where("parts > 1")
    # A large bucket is dealt into blocks of about 256 nodes; a node outside the main component meets one block a row.
    main = main.select("band", "value", F.col("main.root").alias("main"), F.ceil(F.col("members") / SIDE).cast("int").alias("blocks"))
    open_ = held.join(main, ["band", "value"]).join(info.select("node", "n_shingles", "parity", "bands"), "node")
    open_ = written(open_.withColumn("block", F.pmod(F.xxhash64("node", "band"), F.col("blocks").cast("long")).cast("int")), "open")
    x = open_.where("root <> main").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).alias("x")
    y = open_.alias("y")
    apart = (F.col("x.root") != F.col("y.root")) & ((F.col("y.root") == F.col("y.main")) | (F.col("x.node") < F.col("y.node")))
    same = reduce(and_, (F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("band", "value", "block")))
    more = x.join(y, same & apart & may_link("x", "y") & first_met("x", "y"))
    more = more.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
    found = components(links.union(verified(more, sets)))

    # Components of documents: the least doc_id of all nodes of a component.
    grouped = nodes.select("node", "least").join(found, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    least = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    named = written(grouped.join(least, "root").select("node", "component_id"), "named")
    out = rows.select("doc_id", "key", "n_shingles", "node").join(named, "node", "left")
    out = out.select("doc_id", "key", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
    out = out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
    for done in (sets, open_, held, member, info, links, roots, found):
        drop_written(done)
    return out


def drop_near_duplicates(docs: DataFrame, n: int = 5) -> DataFrame:
    """``docs`` with one document of each group: the row with the smallest doc_id; same columns.

    Texts without words are in no group and stay. Rows with a null doc_id stay only where their
    group has no other; of repeated rows one stays.
    """
    groups = assign_groups(docs, n)
    worded = groups.where("n_shingles > 0")
    stay = worded.where("kept").groupBy("doc_id").agg(F.min("key").alias("key"))
    stay = stay.union(worded.where("component_id is null").groupBy("key").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "key"))
    stay = stay.union(groups.where("n_shingles = 0").select("doc_id", "key").distinct())
    stay = stay.select(F.col("doc_id").alias("__id"), F.col("key").alias("__k"))
    out = docs.withColumn("__key", F.xxhash64("text")).join(stay, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__k")))
    repeated = worded.groupBy("doc_id", "key").count().where("count > 1").limit(1).count()
    if repeated:
        bare = groups.where("n_shingles = 0").select(F.col("key").alias("__key")).distinct()
        out = out.join(bare, "__key", "left_anti").dropDuplicates(["__id", "__key"]).unionByName(out.join(bare, "__key", "left_semi"))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))


def op5_circulant_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near copies among all ``documents``, on 4-word shingles; see :func:`assign_groups`."""
    return assign_groups(table(spark, sf_dir, "documents")).drop("key")


ORACLE = r"""
WITH RECURSIVE doc AS (SELECT DISTINCT doc_id, text FROM documents),
words AS (SELECT doc_id, text, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM doc),
place AS (SELECT doc_id, text, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM words WHERE len(w) > 0),
gram AS (SELECT DISTINCT doc_id, text, array_to_string(w[i:i + 3], ' ') AS g FROM place),
sets AS (SELECT doc_id, text, list_sort(list(g)) AS gs, count(*) AS n FROM gram GROUP BY doc_id, text),
node AS (SELECT row_number() OVER (ORDER BY gs) AS node, gs, n, min(doc_id) AS least FROM (SELECT gs, n, doc_id FROM sets) GROUP BY gs, n),
held AS (SELECT node, n, unnest(gs) AS g FROM node),
pair AS (SELECT a.node AS a, b.node AS b, any_value(a.n) AS m, any_value(b.n) AS n, count(*) AS k FROM held a JOIN held b ON a.g = b.g AND a.node <> b.node AND a.n * 100 >= b.n * 80 AND b.n * 100 >= a.n * 80 GROUP BY a.node, b.node),
link AS (SELECT a, b FROM pair WHERE 100 * k >= 80 * (m + n - k)),
reach(node, other) AS (SELECT node, node FROM node UNION SELECT reach.node, link.b FROM reach JOIN link ON reach.other = link.a),
root AS (SELECT reach.node, min(o.least) AS component_id FROM reach JOIN node o ON reach.other = o.node GROUP BY reach.node)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, coalesce(root.component_id, d.doc_id) AS component_id, coalesce(d.doc_id = coalesce(root.component_id, d.doc_id), false) AS kept
FROM documents d LEFT JOIN sets s ON s.doc_id IS NOT DISTINCT FROM d.doc_id AND s.text = d.text LEFT JOIN node ON node.gs = s.gs LEFT JOIN root ON root.node = node.node
"""
