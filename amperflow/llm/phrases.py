"""Phrase collocations: n-gram counts from word-id suffix arrays of shards, merged by key.

A shard is what a task has read, up to 4 MB of text. Its words get ids, its pieces become one
string of ids, and prefix doubling sorts the suffixes by their first words (two doublings are four
words). Runs of neighbours that share n words (LCP intervals) are the n-grams with their counts.
Counts of shards are summed by language and phrase.

Two passes keep rare long phrases out of the shuffle: a phrase of three or four words can reach the
least count only if all its pairs do. Pairs that do are hashed into a bit array of fixed size, by
which the second pass leaves phrases out; it lets some through for nothing, more the fuller it gets,
and never leaves out one that counts, so results do not depend on it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import byte_slices, table, written

#: Words of the longest phrase, least count, scale of scores, share (in hundredths) of a longer phrase that covers, rows reported for each language. Fixed values of the contract.
LONGEST, LEAST, SCALE, COVERED, TOP = 4, 30, 2_000_000, 80, 2000
#: Bytes of a shard, bits of the filter (8 MB), its rows on the way to the driver, and parts that a language is ranked in first.
SHARD, BITS, FOLDS, PARTS = 4 << 20, 1 << 26, 1024, 64
COUNTS = "lang string, phrase string, words int, n long"
PIECE_ENDS, WORD_ENDS = b".,;:!?\n\x0b\x0c\r", b" \t"

_PIECE, _WORD, _LOWER = np.zeros(256, bool), np.zeros(256, bool), np.arange(256, dtype=np.uint8)
_PIECE[list(PIECE_ENDS)] = True
_WORD[list(PIECE_ENDS + WORD_ENDS)] = True
_LOWER[65:91] += 32


def shards(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[tuple[str, np.ndarray]]]:
    """Texts as (language, bytes in lower case), gathered up to ``most`` bytes; longer texts are cut where pieces end."""
    held, size = [], 0
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        for first, end, data, at in byte_slices(batch.column("text"), most):
            for row in range(first, end):
                text = _LOWER[data[at[row - first] : at[row - first + 1]]]
                while len(text):
                    cut = len(text)
                    if cut > most:
                        ends = np.flatnonzero(_PIECE[text[:most]])
                        if not len(ends):
                            ends = np.flatnonzero(_PIECE[text])[:1]
                        cut = int(ends[-1]) + 1 if len(ends) else cut
                    if held and size + cut > most:
                        yield held
                        held, size = [], 0
                    held.append((langs[row], text[:cut]))
                    size, text = size + cut, text[cut:]
    if held:
        yield held


@dataclass
class Words:
    """The words of a shard: ``ids`` with 0 behind each piece, and the language and spelling of ids."""

    ids: np.ndarray
    lang: np.ndarray
    spelled: pa.Array
    langs: list[str]

    def hashes(self) -> np.ndarray:
        return np.fromiter((xxhash.xxh3_64_intdigest(w.encode()) for w in self.spelled.to_pylist()), np.uint64, len(self.spelled))


def words_of(texts: list[tuple[str, np.ndarray]]) -> Words:
    langs = sorted({lang for lang, _ in texts})
    code = {lang: k for k, lang in enumerate(langs)}
    gap = np.array([PIECE_ENDS[0]], np.uint8)
    data = np.concatenate([x for _, text in texts for x in (text, gap)])
    bounds = np.cumsum([len(text) + 1 for _, text in texts])
    blank = _WORD[data]
    starts = np.flatnonzero(~blank & np.append(True, blank[:-1]))
    ends = np.flatnonzero(~blank & np.append(blank[1:], True)) + 1
    piece = np.searchsorted(np.flatnonzero(_PIECE[data]), starts)
    lang = np.array([code[lang] for lang, _ in texts])[np.searchsorted(bounds, starts, side="right")]
    at = np.append(0, np.cumsum(ends - starts)).astype(np.int64)
    every = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(at.tobytes()), pa.py_buffer(data[~blank].tobytes())).dictionary_encode()
    spelled, word = every.dictionary, every.indices.to_numpy().astype(np.int64)
    code_of = word * len(langs) + lang
    met = np.zeros(len(spelled) * len(langs), bool)
    met[code_of] = True
    pairs, ids = np.flatnonzero(met), (np.cumsum(met) - 1)[code_of]
    last = np.append(np.diff(piece) != 0, True) if len(piece) else np.zeros(0, bool)
    # A 0 behind the last word of each piece.
    place = np.arange(len(ids)) + np.append(0, np.cumsum(last)[:-1]) if len(ids) else np.zeros(0, np.int64)
    string = np.zeros(len(ids) + int(last.sum()), np.int64)
    string[place] = ids + 1
    spelled = spelled.take(pa.array(pairs // len(langs))) if len(pairs) else spelled
    of = pairs % len(langs)
    return Words(string, of, spelled, langs)


def pair_bits(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    """Two places in the filter for each pair of word hashes."""
    x = (a * np.uint64(0x9E3779B97F4A7C15)) ^ ((b + np.uint64(0xD1B54A32D192ED03)) * np.uint64(0xBF58476D1CE4E5B9))
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return np.stack([(x >> np.uint64(32)) % np.uint64(bits), (x & np.uint64(0xFFFFFFFF)) % np.uint64(bits)]).astype(np.int64)


def suffixes(ids: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp): suffixes by their first ``depth`` words at least, and the words each shares with the one before, up to ``depth``."""
    n = len(ids)
    rank, width = ids, 1
    order = np.argsort(ids) if depth == 1 else ids
    while width < depth:
        follow = np.zeros(n, np.int64)
        follow[: max(n - width, 0)] = rank[width:] + 1
        key = rank * (int(rank.max(initial=0)) + 2) + follow
        order = np.argsort(key)
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.diff(key[order], prepend=key[order[:1]]) != 0)
        width *= 2
    padded = np.append(ids, np.zeros(depth, np.int64))
    lcp, same = np.zeros(n, np.int64), np.ones(max(n - 1, 0), bool)
    for d in range(depth):
        same &= padded[order[1:] + d] == padded[order[:-1] + d]
        lcp[1:] += same
    return order, lcp


def frequent_runs(ids: np.ndarray, hashes: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The string cut at every pair that is not in the filter, and without runs of fewer than three words."""
    linked = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
    hit = np.ones(len(linked), bool)
    for p in pair_bits(hashes[ids[linked] - 1], hashes[ids[linked + 1] - 1], len(frequent) * 8):
        hit &= (frequent[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1
    joined = np.zeros(len(ids) + 1, bool)  # whether a word and the next one are a frequent pair
    joined[linked[hit]] = True
    starts = np.flatnonzero(joined & ~np.append(False, joined[:-1]))
    ends = np.flatnonzero(~joined & np.append(False, joined[:-1])) + 1
    long = ends - starts > 2
    starts, sizes = starts[long], (ends - starts)[long]
    at = np.append(0, np.cumsum(sizes + 1))
    out = np.zeros(at[-1], np.int64)
    within = np.arange(int(sizes.sum())) - np.repeat(np.append(0, np.cumsum(sizes)[:-1]), sizes) if len(sizes) else np.zeros(0, np.int64)
    out[np.repeat(at[:-1], sizes) + within] = ids[np.repeat(starts, sizes) + within]
    return out


def counted(words: Words, sizes: tuple[int, ...], frequent: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """(lang, phrase, words, n) of the n-grams of a shard, n in ``sizes``: one for each LCP interval of n words or more.

    With ``frequent``, a filter's bits, only n-grams all of whose pairs are in it.
    """
    ids = words.ids
    if not len(ids):
        return
    if frequent is not None:
        ids = frequent_runs(ids, words.hashes(), frequent)
    order, lcp = suffixes(ids, max(sizes))
    padded = np.append(ids, np.zeros(LONGEST, np.int64))
    for n in sizes:
        opens = np.flatnonzero(lcp < n)
        at = order[opens]
        count = np.diff(np.append(opens, len(order)))
        whole = np.ones(len(at), bool)
        for d in range(n):
            whole &= padded[at + d] > 0
        at, count = at[whole], count[whole]
        for k in range(0, len(at), 1 << 16):
            part, c = at[k : k + (1 << 16)], count[k : k + (1 << 16)]
            spelled = [words.spelled.take(pa.array(ids[part + d] - 1)).cast(pa.string()) for d in range(n)]
            phrase = spelled[0] if n == 1 else pc.binary_join_element_wise(*spelled, " ")
            lang = pa.array(words.langs).take(pa.array(words.lang[ids[part] - 1]))
            yield pa.RecordBatch.from_arrays([lang, phrase, pa.array(np.full(len(part), n, np.int32)), pa.array(c.astype(np.int64))], names=["lang", "phrase", "words", "n"])


def shard_counts(docs: DataFrame, sizes: tuple[int, ...], frequent=None, most: int = SHARD) -> DataFrame:
    """Summed counts (lang, phrase, words, n) of all n-grams; ``frequent`` is a broadcast filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if frequent is None else np.frombuffer(frequent.value, np.uint8)
        for texts in shards(batches, most):
            yield from counted(words_of(texts), sizes, bits)

    # Shards hold each phrase once: they are shuffled as they are, without another count on the map side.
    found = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").mapInArrow(run, COUNTS).repartition("lang", "phrase", "words")
    return found.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n"))


def pair_filter(pairs: DataFrame, bits: int = BITS) -> bytes:
    """The bit array of ``bits`` bits of all pairs of ``pairs``: a bound of 8 MB, whatever their number."""
    fold = bits // FOLDS

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [x.split(" ") for x in batch.column("phrase").to_pylist()]
            a, b = (np.fromiter((xxhash.xxh3_64_intdigest(x[k].encode()) for x in both), np.uint64, len(both)) for k in (0, 1))
            p = np.unique(pair_bits(a, b, bits))
            yield pa.RecordBatch.from_arrays([pa.array(p // fold), pa.array(p % fold)], names=["part", "bit"])

    def filled(group: pa.Table) -> pa.Table:
        have = np.zeros(fold, np.uint8)
        have[group.column("bit").to_numpy()] = 1
        return pa.table({"part": group.column("part").slice(0, 1), "bits": pa.array([np.packbits(have, bitorder="little").tobytes()], pa.binary())})

    found = pairs.select("phrase").mapInArrow(places, "part long, bit long").distinct().groupBy("part").applyInArrow(filled, "part long, bits binary")
    out = bytearray(bits // 8)
    for row in found.toLocalIterator():  # 1,024 rows of 8 KB at most
        out[row.part * fold // 8 : (row.part + 1) * fold // 8] = row.bits
    return bytes(out)


def _exact(x: Column) -> Column:
    return x.cast("decimal(28,0)")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, shard: int = SHARD, bits: int = BITS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best ``top`` phrases of two to four words.

    Null languages are ``und``, null and empty texts have no words. Sums and products are decimals,
    exact beyond 64 bits. Ties go by count, then by the phrase's bytes. Repeated rows count each time;
    other columns play no part; an empty table gives no rows.
    """
    spark = docs.sparkSession
    short = written(shard_counts(docs, (1, 2), most=shard).where((F.col("n") >= least) | (F.col("words") == 1)), "phrases-short")
    total = short.where("words = 1").groupBy("lang").agg(F.sum("n").alias("total"))
    short = short.where(F.col("n") >= least)
    filtered = spark.sparkContext.broadcast(pair_filter(short.where("words = 2"), bits))
    long = shard_counts(docs, (3, 4), filtered, shard).where(F.col("n") >= least)
    counts = written(short.unionByName(long), "phrases-counts")
    found = counts.where("words > 1").withColumnRenamed("n", "a")
    w = F.split("phrase", " ")
    part = lambda first, n: F.array_join(F.slice(w, first, n), " ")
    # Parts of a phrase occur at least as often, so their counts are all there.
    cuts = found.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1))).select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.col("words") - F.col("k")).alias("right"))
    of = lambda name, n: counts.select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    cuts = cuts.join(of("left", "l"), ["lang", "left"]).join(of("right", "r"), ["lang", "right"])
    score = F.expr(f"cast({SCALE} as decimal(10,0)) * cast(a as decimal(20,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    # The largest count of a longer phrase that holds a phrase.
    inner = [(n, s) for n in range(2, LONGEST) for s in range(1, LONGEST - n + 2)]
    held = found.where("words > 2").withColumn("inner", F.explode(F.array(*(F.struct(F.lit(n).alias("n"), F.lit(s).alias("s")) for n, s in inner))))
    held = held.where((F.col("inner.n") < F.col("words")) & (F.col("inner.s") + F.col("inner.n") - 1 <= F.col("words")))
    held = held.groupBy("lang", part(F.col("inner.s"), F.col("inner.n")).alias("phrase")).agg(F.max("a").alias("longer"))
    kept = best.join(held, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (_exact(F.col("longer")) * 100 < _exact(F.col("a")) * COVERED))
    kept = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # First within parts of a language, so that no language is ranked whole by one task.
    dealt = kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    dealt = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")


def op12_suffix_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best phrases of each language of ``documents``; see :func:`collocations`."""
    return collocations(table(spark, sf_dir, "documents"))


_GRAMS = " UNION ALL ".join(f"SELECT lang, unnest(list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i:i + {n - 1}], ' '))) AS phrase, {n} AS words FROM p WHERE len(w) >= {n}" for n in range(1, LONGEST + 1))
_CUTS = " UNION ALL ".join(f"SELECT lang, phrase, a, {k} AS k, array_to_string(w[1:{k}], ' ') AS lp, array_to_string(w[{k + 1}:], ' ') AS rp FROM c WHERE words > {k}" for k in range(1, LONGEST))
_INNER = " UNION ALL ".join(f"SELECT lang, array_to_string(w[{s}:{s + n - 1}], ' ') AS phrase, a FROM c WHERE words > {n} AND words >= {s + n - 1}" for n in range(2, LONGEST) for s in range(1, LONGEST - n + 2))
ORACLE = f"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
p AS (SELECT lang, list_filter(string_split_regex(piece, '[ \\x09]+'), lambda x: x <> '') AS w FROM t),
g AS ({_GRAMS}),
f AS (SELECT lang, phrase, words, count(*)::HUGEINT AS a FROM g GROUP BY lang, phrase, words),
n AS (SELECT lang, sum(a) AS n FROM f WHERE words = 1 GROUP BY lang),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE words > 1 AND a >= {LEAST}),
k AS ({_CUTS}),
s AS (SELECT k.lang, k.phrase, k.a, k.k, x.a AS l, y.a AS r, ({SCALE} * k.a) // (x.a + y.a) AS score FROM k JOIN f x ON x.lang = k.lang AND x.phrase = k.lp JOIN f y ON y.lang = k.lang AND y.phrase = k.rp),
b AS (SELECT lang, phrase, a, min((score, k, l, r)) AS cut FROM s GROUP BY lang, phrase, a),
i AS (SELECT lang, phrase, max(a) AS longer FROM ({_INNER}) GROUP BY lang, phrase),
o AS (SELECT b.* FROM b LEFT JOIN i USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < {COVERED} * a),
q AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY cut[1] DESC, a DESC, encode(phrase)) AS rank FROM o)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, cut[3]::BIGINT AS l, cut[4]::BIGINT AS r, n::BIGINT AS n, cut[1]::BIGINT AS score FROM q JOIN n USING (lang) WHERE rank <= {TOP}
"""
