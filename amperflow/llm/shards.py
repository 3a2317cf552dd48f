"""Sharding: a Feistel permutation with cycle walking over global row numbers.

Every row gets a row number that depends only on the table's rows; a keyed permutation of
``[0, n)`` shuffles these numbers; shard and slot then follow by division. Whoever knows n, the
seed and a row number can compute the row's place without reading anything.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

SHARDS, SEED, ROUNDS, BUCKETS = 8, 20240229, 6, 4096


def feistel(x: np.ndarray, n: int, seed: int = SEED, rounds: int = ROUNDS) -> np.ndarray:
    """A permutation of ``[0, n)`` applied to the array ``x`` of uint64 row numbers.

    The network works on pairs (left < a, right < b) with a * b just over n. What falls outside
    ``[0, n)`` walks along its cycle until it falls inside, so the result is a permutation again.
    """
    if n <= 1:
        return np.zeros_like(x)
    a = int(np.ceil(np.sqrt(n)))
    b = -(-n // a)
    a_, b_ = np.uint64(a), np.uint64(b)

    def mix(v: np.ndarray, k: int) -> np.ndarray:
        key = np.uint64((seed * 0x9E3779B97F4A7C15 + (k + 1) * 0xD1B54A32D192ED03) & 0xFFFFFFFFFFFFFFFF)
        v = (v + key) * np.uint64(0xBF58476D1CE4E5B9)
        v = (v ^ (v >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return v ^ (v >> np.uint64(32))

    def once(v: np.ndarray) -> np.ndarray:
        left, right = v // b_, v % b_
        for k in range(rounds):
            if k % 2:
                right = (right + mix(left, k) % b_) % b_
            else:
                left = (left + mix(right, k) % a_) % a_
        return left * b_ + right

    out = once(x)
    while len(outside := np.flatnonzero(out >= np.uint64(n))):
        out[outside] = once(out[outside])
    return out


def place(row: int, n: int, shards: int = SHARDS, seed: int = SEED) -> tuple[int, int]:
    """Shard and slot of one row number."""
    p = int(feistel(np.array([row], np.uint64), n, seed)[0])
    return p % shards, p // shards


def assign_shards(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row of ``docs``.

    The law is ``rows``: shards' row counts differ by one at most. Rows are numbered by hash
    bucket, then doc_id, CRC, size and text hash; equal rows are counted first and numbered
    together, so a row repeated any number of times makes no large group. Null texts count as
    missing (size 1, CRC of no bytes), null doc_ids come first; an empty table gives no rows.
    ``buckets`` bounds the one table of offsets that is broadcast.
    """
    text = F.col("text").cast("binary")
    number = lambda c: F.conv(F.substring(F.md5(c), 1, 15), 16, 10).cast("long")  # noqa: E731  60 bits, as SQL has them too
    narrow = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"),
        F.coalesce(number(text), F.lit(-1).cast("long")).alias("h"),
    )
    # Equal rows meet after a map-side count; the bucket keeps the next sort spread over the cluster.
    same = narrow.groupBy("doc_id", "size", "text_crc32", "h").agg(F.count("*").alias("copies"))
    bucket = F.pmod(number(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.col("h").cast("string")).cast("binary")), F.lit(buckets)).cast("int")
    same = same.withColumn("bucket", bucket)
    sums = narrow.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("rows"))
    found = {r["bucket"]: r["rows"] for r in sums.collect()}  # at most ``buckets`` rows
    n = sum(found.values())
    starts, before = [], 0
    for k in sorted(found):
        starts.append((k, before))
        before += found[k]
    offsets = docs.sparkSession.createDataFrame(starts, "bucket int, offset long")
    run = Window.partitionBy("bucket").orderBy("doc_id", "text_crc32", "size", "h")
    numbered = same.withColumn("upto", F.sum("copies").over(run.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    numbered = numbered.join(F.broadcast(offsets), "bucket").select(
        "doc_id", "size", "text_crc32", (F.col("offset") + F.col("upto") - F.col("copies")).alias("first"), "copies"
    )
    # A row of very many copies is dealt out in blocks, so that no array grows with the data.
    block = 10_000
    numbered = (
        numbered.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / block).cast("long"))))
        .withColumn("row", F.explode(F.sequence(F.col("first") + F.col("part") * block, F.col("first") + F.least(F.col("copies"), (F.col("part") + 1) * block) - 1)))
    )

    @F.pandas_udf("long")
    def shuffled(rows: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in rows:
            yield pd.Series(feistel(x.to_numpy().astype(np.uint64), n, seed).astype(np.int64))

    placed = numbered.withColumn("p", shuffled("row"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), (F.col("p") % shards).cast("int").alias("shard"),
        F.floor(F.col("p") / shards).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def op10_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` in shards 0 to 7 by the law ``rows``; see :func:`assign_shards`."""
    return assign_shards(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _mixed(v: str, k: str) -> str:
    """SQL of the round function: 64-bit products by way of 128 bits."""
    wrap = "18446744073709551616::UHUGEINT"
    keys = ", ".join(f"{(SEED * 0x9E3779B97F4A7C15 + (j + 1) * 0xD1B54A32D192ED03) % 2**64}::UHUGEINT" for j in range(ROUNDS))
    one = f"(((({v}::UHUGEINT + ([{keys}])[{k} + 1]) % {wrap}) * {0xBF58476D1CE4E5B9}::UHUGEINT) % {wrap})::UBIGINT"
    two = f"(((xor({one}, {one} >> 29))::UHUGEINT * {0x94D049BB133111EB}::UHUGEINT) % {wrap})::UBIGINT"
    return f"xor({two}, {two} >> 32)"


ORACLE = f"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda k: list_reduce(list_prepend(k, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
d AS (SELECT doc_id, encode(text) AS b, coalesce(octet_length(encode(text)), 0)::BIGINT AS n, coalesce(('0x' || substr(md5(text), 1, 15))::BIGINT, -1) AS h FROM documents),
s AS (SELECT doc_id, n + 1 AS size, h, CASE WHEN n = 0 THEN 0 ELSE xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, n + 1), lambda i: ('0x' || hex(b[i:i]))::BIGINT)), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) END::BIGINT AS text_crc32 FROM d, crc),
g AS (SELECT *, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '-') || ':' || h), 1, 15))::BIGINT % {BUCKETS} AS bucket FROM s),
r AS (SELECT doc_id, size, text_crc32, row_number() OVER (ORDER BY bucket, doc_id NULLS FIRST, text_crc32, size, h) - 1 AS row FROM g),
m AS (SELECT count(*) AS n, ceil(sqrt(count(*)))::BIGINT AS a, ceil(count(*) / ceil(sqrt(count(*))))::BIGINT AS b FROM r),
walk(row, l, r, k, n, a, b, over) AS (
  SELECT row, row // b, row % b, 0, n, a, b, n <= 1 FROM r, m
  UNION ALL SELECT row, CASE WHEN k = {ROUNDS} THEN (l * b + r) // b WHEN k % 2 = 0 THEN (l + ({_mixed("r", "k")} % a)::BIGINT) % a ELSE l END, CASE WHEN k = {ROUNDS} THEN (l * b + r) % b WHEN k % 2 = 1 THEN (r + ({_mixed("l", "k")} % b)::BIGINT) % b ELSE r END,
   CASE WHEN k = {ROUNDS} THEN 0 ELSE k + 1 END, n, a, b, k = {ROUNDS - 1} AND false FROM walk WHERE NOT over AND NOT (k = {ROUNDS} AND l * b + r < n)),
p AS (SELECT row, CASE WHEN over THEN 0 ELSE l * b + r END AS p FROM walk WHERE over OR (k = {ROUNDS} AND l * b + r < n))
SELECT doc_id, size, text_crc32, 'rows' AS law, (p % {SHARDS})::INTEGER AS shard, (p // {SHARDS})::BIGINT AS slot, NULL::INTEGER AS grown_shard FROM r JOIN p USING (row)
"""
