"""Line dedup: a sharded minimal perfect hash over distinct line hashes.

Every distinct line key is one 128-bit hash. Shards of some 8,192 hashes each get a minimal perfect
hash: level by level, hashes that are alone in their slot of a bit array keep it, the others go to
the next level; the rank of a set bit is the hash's place in compact arrays of fingerprints, counts
and first holders. Documents do not join lines: the hashes of their lines stream past the arrays of
their shard, one shard at a time, so that a task holds one shard's arrays and one batch of hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_written, table, written

#: Shortest key that counts, in code points, and what is stripped from lines. Fixed values of the contract.
SHORTEST, BLANK = 10, " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hashes a shard has on average, slots of a level for each hash, and the most shards that are split for their load.
SHARD, SPARE, HOT_SHARDS = 8192, 2.0, 1000
MOST = np.uint64((1 << 32) - 1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slots(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
    """The slot of each hash (a, b) on a level of ``size`` slots."""
    return (mixed(a ^ mixed(b + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))) % np.uint64(size)).astype(np.int64)


def prints(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (mixed(b ^ (a >> np.uint64(7))) & MOST).astype(np.uint32)


class LineIndex:
    """The minimal perfect hash of one shard and its arrays; ``a`` and ``b`` are distinct pairs of uint64."""

    def __init__(self, sizes: list[int], bits: np.ndarray, prints_: np.ndarray, counts: np.ndarray, owners: np.ndarray):
        self.sizes, self.bits, self.prints, self.counts, self.owners = sizes, bits, prints_, counts, owners
        self.ranks = np.cumsum(bits) - 1

    @classmethod
    def built(cls, a: np.ndarray, b: np.ndarray, counts: np.ndarray, owners: np.ndarray) -> LineIndex:
        left, sizes, levels = np.arange(len(a)), [], []
        while len(left):
            size = int(len(left) * SPARE) + 8
            at = slots(a[left], b[left], len(sizes), size)
            held = np.bincount(at, minlength=size)
            sizes.append(size)
            levels.append(held == 1)
            left = left[held[at] > 1]
        bits = np.concatenate(levels) if levels else np.zeros(0, bool)
        made = cls(sizes, bits, np.empty(len(a), np.uint32), np.empty(len(a), np.uint32), np.empty(len(a), np.int64))
        at, _ = made.places(a, b)
        made.prints[at], made.counts[at], made.owners[at] = prints(a, b), np.minimum(counts.astype(np.uint64), MOST), owners
        return made

    def places(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, whether there is one): hashes that the index was not built over may have one too."""
        out, left, first = np.full(len(a), -1), np.arange(len(a)), 0
        for level, size in enumerate(self.sizes):
            at = first + slots(a[left], b[left], level, size)
            hit = self.bits[at]
            out[left[hit]] = self.ranks[at[hit]]
            left, first = left[~hit], first + size
        return out, out >= 0

    def found(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, owner) of each hash; a count of 0 where the fingerprint is another's."""
        at, known = self.places(a, b)
        counts, owners = np.zeros(len(a), np.uint32), np.zeros(len(a), np.int64)
        k = np.flatnonzero(known)
        k = k[self.prints[at[k]] == prints(a[k], b[k])]
        counts[k], owners[k] = self.counts[at[k]], self.owners[at[k]]
        return counts, owners

    def packed(self) -> bytes:
        head = np.array([len(self.sizes), len(self.prints), *self.sizes], "<i8")
        return b"".join((head.tobytes(), self.owners.astype("<i8").tobytes(), self.prints.astype("<u4").tobytes(), self.counts.astype("<u4").tobytes(), np.packbits(self.bits).tobytes()))

    @classmethod
    def unpacked(cls, data: bytes) -> LineIndex:
        levels, n = (int(x) for x in np.frombuffer(data, "<i8", 2))
        sizes = [int(x) for x in np.frombuffer(data, "<i8", levels, 16)]
        at = 16 + 8 * levels
        owners = np.frombuffer(data, "<i8", n, at)
        prints_, counts = np.frombuffer(data, "<u4", n, at + 8 * n), np.frombuffer(data, "<u4", n, at + 12 * n)
        bits = np.unpackbits(np.frombuffer(data, np.uint8, -1, at + 16 * n), count=sum(sizes)).astype(bool)
        return cls(sizes, bits, prints_, counts, owners)


def line_key(line: Column) -> Column:
    return F.translate(F.trim(line, F.lit(BLANK)), UPPER, LOWER)


def hashed_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, of, at, a, b) for each line with a key long enough: the text's hash, the line's number, the key's hash."""
    text = F.coalesce("text", F.lit(""))
    lines = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("of"), F.posexplode(F.split(text, "\n", -1)).alias("at", "line"))
    keys = lines.select("doc_id", "of", "at", line_key(F.col("line")).alias("key")).where(F.length("key") >= SHORTEST)
    return keys.select("doc_id", "of", "at", F.xxhash64("key").alias("a"), F.xxhash64(F.lit(1), "key").alias("b"))


def _build(group: pa.Table) -> pa.Table:
    column = lambda name: group.column(name).to_numpy()
    index = LineIndex.built(column("a").view(np.uint64), column("b").view(np.uint64), column("n"), group.column("owner").fill_null(0).to_numpy())
    return pa.table({"shard": group.column("shard").slice(0, 1), "load": pa.array([int(column("lines").sum())], pa.int64()), "index": pa.array([index.packed()], pa.binary())})


def index_lines(docs: DataFrame, per_shard: int = SHARD) -> tuple[DataFrame, int]:
    """((shard, load, index), number of shards): one row for each shard of the distinct lines of ``docs``.

    Counts are of lines, and 0 for a key that only one document holds. Rows of one doc_id are one
    document; rows without a doc_id are one document too, after all others.
    """
    keys = hashed_lines(docs).groupBy("a", "b").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last"), F.count("*").alias("lines"), F.count("doc_id").alias("known"))
    shared = (F.col("owner") != F.col("last")) | ((F.col("known") > 0) & (F.col("known") < F.col("lines")))
    keys = written(keys.select("a", "b", "owner", "lines", F.when(shared, F.col("lines")).otherwise(0).alias("n")), "lines-keys")
    shards = max(1, -(-keys.count() // per_shard))
    index = keys.withColumn("shard", F.pmod("a", F.lit(shards))).groupBy("shard").applyInArrow(_build, "shard long, load long, index binary")
    index = written(index, "lines-index")
    drop_written(keys)
    return index, shards


def _probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by shard and part, each with its index first: (doc_id, of, at) of the lines that go."""
    index = None
    for batch in batches:
        here = np.asarray(batch.column("index").is_valid())
        cuts = [0, *np.flatnonzero(here).tolist(), batch.num_rows]
        for first, end in zip(cuts, cuts[1:], strict=False):
            if first < end and here[first]:
                index, first = LineIndex.unpacked(batch.column("index")[first].as_py()), first + 1
            part = batch.slice(first, end - first)
            if not part.num_rows or index is None:
                continue
            a, b = (part.column(c).to_numpy().view(np.uint64) for c in "ab")
            counts, owners = index.found(a, b)
            ids = part.column("doc_id")
            mine = np.asarray(ids.is_valid()) & (ids.fill_null(0).to_numpy() == owners)
            gone = pa.array((counts > 0) & ~mine)
            yield part.select(["doc_id", "of", "at"]).filter(gone)


def repeated_lines(docs: DataFrame, index: DataFrame, shards: int) -> DataFrame:
    """(doc_id, of, at) of the lines of ``docs`` that the index knows from several documents, but for the first holder's own.

    A shard whose load is beyond a thousandth of all (and four times the average) is split: its
    arrays are copied, its lines dealt out by their place. At most 1,000 shards can be, so their
    table may be broadcast. ``docs`` may be others than those of the index: a line that it was not
    built over is told apart by a fingerprint of 32 bits.
    """
    total = index.agg(F.coalesce(F.sum("load"), F.lit(0))).first()[0]
    most = max(total // HOT_SHARDS, 4 * total // shards) + 1
    hot = F.broadcast(index.where(F.col("load") > most).select("shard", F.ceil(F.col("load") / most).cast("int").alias("parts")))
    split = lambda df: df.join(hot, "shard", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    arrays = split(index).select("shard", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "index")
    probes = split(hashed_lines(docs).withColumn("shard", F.pmod("a", F.lit(shards))))
    probes = probes.withColumn("part", F.pmod(F.xxhash64("doc_id", "of", "at"), F.col("parts")).cast("int")).drop("parts")
    both = arrays.unionByName(probes, allowMissingColumns=True).withColumn("rest", F.col("index").isNull())
    both = both.repartition("shard", "part").sortWithinPartitions("shard", "part", "rest")
    return both.select("index", "a", "b", "doc_id", "of", "at").mapInArrow(_probed, "doc_id long, of long, at int")


def drop_repeated_lines(docs: DataFrame, per_shard: int = SHARD) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept): every row of ``docs``, its text without lines that an earlier document holds.

    A key is the line stripped of white space, with A-Z in lower case. Keys of at least 10 code points in
    at least two documents lose all lines but those of the smallest doc_id. Null and empty texts are
    one empty line, which stays. Rows with one doc_id are one document; rows without a doc_id are one
    document after all others. Repeated rows are kept and treated alike; other columns play no part.
    An empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    index, shards = index_lines(docs, per_shard)
    gone = repeated_lines(docs, index, shards).groupBy("doc_id", "of").agg(F.sort_array(F.collect_set("at")).alias("gone"))
    gone = gone.select(F.col("doc_id").alias("__id"), F.col("of").alias("__of"), "gone")
    rows = docs.withColumn("of", F.xxhash64("text")).join(gone, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("of") == F.col("__of")), "left")
    lines = F.split("text", "\n", -1)
    gaps = F.zip_with(F.concat(F.array(F.lit(-1)), "gone"), F.concat("gone", F.array(F.size("lines"))), lambda s, e: F.slice(F.col("lines"), s + 2, e - s - 1))
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.flatten(gaps), "\n"))
    return rows.withColumn("lines", lines).select("doc_id", F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept"))


def op11_perfect_hash_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every ``documents`` row that an earlier document holds go; see :func:`drop_repeated_lines`."""
    out = drop_repeated_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = f"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM l),
f AS (SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= {SHORTEST} GROUP BY key HAVING count(DISTINCT doc_id) > 1),
m AS (SELECT k.*, f.owner IS NOT NULL AND f.owner <> doc_id AS gone FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id
"""
