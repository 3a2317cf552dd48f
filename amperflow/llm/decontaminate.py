"""Benchmark decontamination: which documents hold a test item, by MinHash containment.

Sets are the distinct 5-word shingles of a text's words (runs of letters and digits, lower case).
An item is contained where at least 0.8 of its shingles occur in the document, however long that
is. Items are partitioned by the size of their sets; a partition's size bounds how many shingles
may be missing, hence how many of the smallest hash values (the item's MinHash sketch under one
permutation) must be looked up so that a containing document shares at least one: q - ceil(0.8 q)
may be missing, so one more than that. Documents are not sketched, their hashes are probed
against the sketches; no length of a document weakens the search. Candidates are then verified by
exact containment of their shingles. Everything is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

WORDS, THRESHOLD = 5, 80  # per cent
#: Rows up to which sketches (20 bytes each) and keys of documents (8 bytes each) are broadcast, counted first; beyond, both sides shuffle.
BROADCAST_ROWS = 200_000


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 0)


def shingle_hashes(words: Column, n: int) -> Column:
    """Distinct hashes of the ``n``-word shingles of an array of words; empty where there are fewer.

    The words are bound once to a lambda's variable, so that the optimizer, wherever it moves this
    expression, never has them computed again for every word.
    """

    def of(w: Column) -> Column:
        hashed = F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(n))))
        return F.when(F.size(w) >= n, F.array_distinct(hashed)).otherwise(F.array().cast("array<bigint>"))

    return F.get(F.transform(F.array(words), of), 0)


def item_sets(items: DataFrame, n: int = WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """item_id, set_id, shingle size ``n`` (fewer for shorter items), set ``hashes``, set size ``q``, needed matches, sketch.

    Items are told apart by their set (``set_id`` is a hash of it): item_id may repeat or be null, and
    items of equal texts share a set. Items without a word have no set and are left out. ``part`` is the
    size partition: sets of q up to twice its lower bound.
    """
    w = items.select("item_id", words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    w = w.withColumn("n", F.least(F.size("w"), F.lit(n)))
    sized = F.lit(None).cast("array<bigint>")
    for k in range(1, n + 1):
        sized = F.when(F.col("n") == k, shingle_hashes(F.col("w"), k)).otherwise(sized)
    sets = w.select("item_id", "n", F.array_sort(sized).alias("hashes")).distinct()
    sets = sets.withColumn("q", F.size("hashes")).withColumn("need", F.ceil(F.col("q") * threshold / 100).cast("int")).withColumn("set_id", F.xxhash64("n", "hashes"))
    # Within a size partition the bound of its largest set holds; a set has no more values than that.
    sets = sets.withColumn("part", F.floor(F.log2("q")).cast("int"))
    allowed = (F.pow(F.lit(2), F.col("part") + 1).cast("int") - 1) - F.ceil((F.pow(F.lit(2), F.col("part") + 1) - 1) * threshold / 100).cast("int")
    sets = sets.withColumn("sketch", F.slice("hashes", 1, F.least(allowed + 1, F.col("q"))))
    return sets


def few(df: DataFrame, rows: int) -> bool:
    return df.limit(rows + 1).count() <= rows


def contained_items(docs: DataFrame, items: DataFrame, n: int = WORDS, threshold: int = THRESHOLD, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared, containment), one row per document and item it contains.

    Null texts and texts without words contain nothing; repeated rows of documents or items give
    one row; rows with a null doc_id or item_id are compared like others. Broadcast are only pairs
    of a sketch value and a set's id, and keys of documents that hold a sketch value, each while they
    have at most ``broadcast_rows`` rows (counted first); never sets or texts. A document is known by
    a hash of its text, so copies of a text are candidates once.
    """
    items = written(item_sets(items, n, threshold), "items")
    sizes = sorted(r[0] for r in items.select("n").distinct().collect())  # at most n values
    sketches = items.select("n", "set_id", F.explode("sketch").alias("h")).distinct()
    near = F.broadcast if few(sketches, broadcast_rows) else lambda df: df
    sets = items.select("set_id", "q", "need", "hashes").dropDuplicates(["set_id"])
    texts = docs.select(F.col("doc_id").alias("doc_id"), F.xxhash64("text").alias("key"), "text").where(F.length("text") > 0)
    result = None
    for k in sizes:  # 5, and the lengths of shorter items if there are any
        own = lambda df: df.withColumn("__own", shingle_hashes(words_of(F.col("text")), k))  # noqa: E731, B023
        sketch = sketches.where(F.col("n") == k).select("h", "set_id")
        hit = own(texts).select("key", F.explode("__own").alias("h")).join(near(sketch), "h").select("key", "set_id").distinct()
        hit = written(hit, "candidates")
        # Only documents that share a sketch value come back with their whole sets.
        keys = hit.select("key").distinct()
        back = texts.join(F.broadcast(keys) if few(keys, broadcast_rows) else keys, "key", "left_semi")
        checked = own(back).select("doc_id", "key", "__own").join(hit, "key").join(sets, "set_id")
        checked = checked.withColumn("n_shared", F.size(F.array_intersect("hashes", "__own")).cast("long")).where(F.col("n_shared") >= F.col("need"))
        found = checked.join(items.select("set_id", "item_id").distinct(), "set_id").select("doc_id", "item_id", F.col("q").cast("long").alias("n_item"), "n_shared", (F.col("n_shared") / F.col("q")).alias("containment"))
        result = found if result is None else result.unionByName(found)
    if result is None:
        return docs.select(F.col("doc_id").cast("long").alias("doc_id")).limit(0).selectExpr("doc_id", "cast(null as bigint) item_id", "0L n_item", "0L n_shared", "0D containment")
    return result.groupBy("doc_id", "item_id").agg(F.max_by(F.struct("n_item", "n_shared", "containment"), F.struct("containment", "n_item")).alias("r")).select("doc_id", "item_id", "r.*")


def drop_contaminated(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """``docs`` without the rows whose text contains an item; all other rows and columns stay.

    Rows are matched by doc_id and text, so that of rows that share a doc_id only those with an
    item go. Rows with a null doc_id can go as well.
    """
    texts = docs.select(F.xxhash64("text").alias("doc_id"), "text")
    bad = written(contained_items(texts, items, **how).select(F.col("doc_id").alias("__key")).distinct(), "contaminated")
    bad = F.broadcast(bad) if few(bad, how.get("broadcast_rows", BROADCAST_ROWS)) else bad
    return docs.withColumn("__key", F.xxhash64("text")).join(bad, "__key", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def op3_containment_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items of ``benchmark`` that each document contains; see :func:`contained_items`."""
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH words AS (
  SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark WHERE text IS NOT NULL
), item AS (
  SELECT DISTINCT item_id, w, least(len(w), 5) AS n FROM words WHERE len(w) > 0
), place AS (SELECT item_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM item),
shingle AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM place),
size AS (SELECT item_id, n, count(*) AS q FROM shingle GROUP BY item_id, n),
doc AS (
  SELECT doc_id, n, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents, (SELECT DISTINCT n FROM item) WHERE text IS NOT NULL
), held AS (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM doc WHERE len(w) >= n),
grams AS (SELECT DISTINCT doc_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM held),
hits AS (SELECT doc_id, item_id, n, count(*) AS n_shared FROM grams JOIN shingle USING (n, g) GROUP BY doc_id, item_id, n)
SELECT doc_id, item_id, q::BIGINT AS n_item, n_shared::BIGINT AS n_shared, n_shared::DOUBLE / q AS containment FROM hits JOIN size USING (item_id, n) WHERE n_shared * 100 >= q * 80
"""
