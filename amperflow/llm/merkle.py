"""A Merkle manifest of a table: a tree for each source, and one over the trees' roots.

Leaves of a source are numbered in order; aligned blocks of 16^3 leaves are walked in postorder,
each call returning the digest of its subtree and, while it unwinds, appending the siblings of a run
to the path of each node below. Roots of blocks are the leaves of the next distributed walk, until
every source has one root; those are the leaves of one more tree. Paths then come down the same way:
a block is walked again beside the path of its root. No task holds more than one block.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written
from .lines import LOWER, UPPER

#: Nodes of a run, and levels of a block. The first is a fixed value of the contract.
RUN, LEVELS = 16, 3
BLOCK = RUN**LEVELS
PATH = "array<struct<before:string,after:string>>"
ARROW_PATH = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))
NODE = "tree string, at long, size long, digest string"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def levels_of(size: int) -> int:
    """Levels that a block of a tree of ``size`` nodes goes up: all of them, or fewer where they end in one node."""
    n = 0
    while n < LEVELS and size > RUN**n:
        n += 1
    return n


def walk(nodes: list[str], level: int, paths: list[list[tuple[str, str]]] | None = None, first: int = 0) -> str:
    """The digest ``level`` levels above ``nodes``; appends (before, after), a run's other digests, to the path of each node."""
    if level == 0:
        return nodes[0]
    step = RUN ** (level - 1)
    starts = range(0, len(nodes), step)
    run = [walk(nodes[s : s + step], level - 1, paths, first + s) for s in starts]
    if paths is not None:
        for k, s in enumerate(starts):
            siblings = "".join(run[:k]), "".join(run[k + 1 :])
            for path in paths[first + s : first + min(s + step, len(nodes))]:
                path.append(siblings)
    return digest("".join(run))


def folded(x: str, path: list[tuple[str, str]]) -> str:
    """The root that a leaf gives with its siblings, level by level."""
    for before, after in path:
        x = digest(before + x + after)
    return x


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``at`` (from 0, within each ``tree``, by ``order``) and ``size`` of the tree; written, as places must not change.

    Rows are sorted by range over the cluster; equal rows too are dealt out, as places among them do
    not matter. What is before a range in its tree is a sum over ranges.
    """
    keys = ["tree", *order, "__tie"]
    rows = rows.withColumn("__tie", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("__tie").withColumn("__id", F.monotonically_increasing_id())
    rows = written(rows.withColumn("__part", F.shiftright("__id", 33)), "merkle-order")
    ranges = rows.groupBy("tree", "__part").agg(F.min("__id").alias("__first"), F.count("*").alias("__n"))
    tree = Window.partitionBy("tree")  # as many rows as a tree has ranges
    before = F.sum("__n").over(tree.orderBy("__part")) - F.col("__n")
    ranges = ranges.select("tree", "__part", "__first", before.alias("__before"), F.sum("__n").over(tree).alias("size"))
    out = rows.join(ranges, ["tree", "__part"]).withColumn("at", F.col("__before") + F.col("__id") - F.col("__first"))
    return written(out.drop("__part", "__id", "__first", "__before"), "merkle-leaves")


def _sorted(group: pa.Table) -> pa.Table:
    return group.sort_by("at")


def _roots(group: pa.Table) -> pa.Table:
    group = _sorted(group)
    size, at = group.column("size")[0].as_py(), group.column("at")[0].as_py()
    root = walk(group.column("digest").to_pylist(), levels_of(size))
    return pa.table({"tree": group.column("tree").slice(0, 1), "at": [at // BLOCK], "size": [-(-size // BLOCK)], "digest": [root]})


def _block() -> Column:
    return F.floor(F.col("at") / BLOCK).cast("long").alias("block")


def climb(leaves: DataFrame) -> list[DataFrame]:
    """``leaves`` (tree, at, size, digest) and the nodes above them, walk by walk, up to one for each tree."""
    out, most = [leaves], leaves.agg(F.max("size")).first()[0] or 0
    while most > 1:
        out.append(written(out[-1].select("tree", "at", "size", "digest").groupBy("tree", _block()).applyInArrow(_roots, NODE), "merkle-nodes"))
        most = -(-most // BLOCK)
    return out


def _paths(group: pa.Table, above: pa.Table) -> tuple[pa.Table, list[list[tuple[str, str]]]]:
    """The sorted block, and each node's path: its own part within the block and that of the block's root."""
    group = _sorted(group)
    paths: list[list[tuple[str, str]]] = [[] for _ in range(group.num_rows)]
    walk(group.column("digest").to_pylist(), levels_of(group.column("size")[0].as_py()), paths)
    rest = [(p["before"], p["after"]) for p in above.column("path")[0].as_py()]
    return group, [p + rest for p in paths]


def _down(group: pa.Table, above: pa.Table) -> pa.Table:
    if not group.num_rows:
        return pa.table({"tree": pa.array([], pa.string()), "at": pa.array([], pa.int64()), "path": pa.array([], ARROW_PATH)})
    group, paths = _paths(group, above)
    told = [[{"before": b, "after": a} for b, a in p] for p in paths]
    return pa.table({"tree": group.column("tree"), "at": group.column("at"), "path": pa.array(told, ARROW_PATH)})


def descend(walks: list[DataFrame], top: DataFrame) -> DataFrame:
    """(tree, at, path) of the nodes one walk above the leaves of ``climb``, from the paths of the trees' roots."""
    path = top
    for nodes in reversed(walks[1:-1]):
        left, right = nodes.groupBy("tree", _block()), path.groupBy("tree", F.col("at").alias("block"))
        path = written(left.cogroup(right).applyInArrow(_down, f"tree string, at long, path {PATH}"), "merkle-paths")
    return path


def _proofs(group: pa.Table, above: pa.Table) -> pa.Table:
    names = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    if not group.num_rows:
        return pa.table({n: pa.array([], pa.int64() if n == "doc_id" else pa.bool_() if n == "verified" else pa.string()) for n in names})
    group, paths = _paths(group, above)
    root, subroot = above.column("root")[0].as_py(), above.column("subroot")[0].as_py()
    n = group.num_rows
    proofs = [digest("".join(b + a for b, a in p)) for p in paths]
    roots = [folded(x, p) for x, p in zip(group.column("tampered").to_pylist(), paths, strict=True)]
    return pa.table({
        "doc_id": group.column("doc_id"), "leaf": group.column("digest"), "subroot": pa.array([subroot] * n, pa.string()), "root": pa.array([root] * n, pa.string()),
        "proof_sha256": pa.array(proofs, pa.string()), "folded_root": pa.array(roots, pa.string()), "verified": pa.array([r == root for r in roots]),
    })


def leaf_digest(columns: list[Column]) -> Column:
    """SHA-256 of values, each ``-`` if null, else its UTF-8 byte count, a colon and the value."""
    told = lambda c: F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    return F.sha2(F.concat(*(told(c) for c in columns)), 256)


def manifest(docs: DataFrame, tampered: Column) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for each row of ``docs``.

    ``tampered`` is the text under which the row is checked; the leaf and its siblings are of the
    true one. Leaves of a source ascend by doc_id, null first; rows with equal doc_ids by leaf; equal
    rows are leaves of their own. Null sources are one source, before all others. Null values are
    told apart from empty ones. Other columns play no part; an empty table gives no rows.
    """
    c = F.col
    facts = [c("doc_id"), c("source"), c("lang"), c("n_chars")]
    rows = docs.select(
        c("doc_id").cast("long").alias("doc_id"), F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("tree"), leaf_digest([*facts, c("text")]).alias("digest"), leaf_digest([*facts, tampered]).alias("tampered"),
    )
    leaves = numbered(rows, ["doc_id", "digest"])
    walks = climb(leaves)
    subroots = walks[-1].select(F.lit("").alias("tree"), c("tree").alias("source"), "digest")
    tops = climb(numbered(subroots, ["source"]))
    root = tops[-1].select(F.lit("").alias("tree"), F.lit(0).cast("long").alias("at"), F.array().cast(PATH).alias("path"), c("digest").alias("root"))
    # The tree over the sources: one more walk brings the path of each subroot, then that of each block of leaves.
    over = descend(tops, root.drop("root"))
    named = tops[0].groupBy("tree", _block()).cogroup(over.groupBy("tree", c("at").alias("block"))).applyInArrow(_down, f"tree string, at long, path {PATH}")
    named = tops[0].select("at", "source", "digest").join(named.select("at", "path"), "at")
    of_tree = written(named.crossJoin(F.broadcast(root.select("root"))).select(c("source").alias("tree"), F.lit(0).cast("long").alias("at"), "path", c("digest").alias("subroot"), "root"), "merkle-sources")  # one row
    path = descend(walks, of_tree.select("tree", "at", "path"))
    facts_of = of_tree.select(c("tree").alias("__tree"), "subroot", "root")
    above = path.join(facts_of, c("tree") == c("__tree")).drop("__tree")
    left, right = leaves.groupBy("tree", _block()), above.groupBy("tree", c("at").alias("block"))
    return left.cogroup(right).applyInArrow(_proofs, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def tampered_text() -> Column:
    """The text, with A-Z in lower case where 5 divides the CRC of the decimal doc_id (never for a null one)."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return F.when(hit, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots, proof and check of every ``documents`` row; see :func:`manifest`."""
    return manifest(table(spark, sf_dir, "documents"), tampered_text())


def _levels(first: str, name: str, n: int) -> str:
    """SQL of ``n`` levels above the nodes (t, i, h, n) of ``first``: nodes and the runs below them."""
    out, below = [], first
    for k in range(1, n + 1):
        out.append(f"""{name}{k} AS (SELECT t, i // {RUN} AS i, CASE WHEN max(n) = 1 THEN max(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h, (max(n) + {RUN - 1}) // {RUN} AS n,
 CASE WHEN max(n) = 1 THEN [] ELSE list(h ORDER BY i) END AS run FROM {below} GROUP BY t, i // {RUN})""")
        below = f"{name}{k}"
    return ",\n".join(out)


def oracle(levels: int = 6, tops: int = 3) -> str:
    """SQL for up to 16^levels rows of a source and 16^tops sources."""
    told = lambda x: f"coalesce(octet_length(encode({x})) || ':' || {x}, '-')"
    facts = " || ".join(told(x) for x in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR"))
    runs = [(f"a{k}.run", f"(l.i // {RUN ** (k - 1)}) % {RUN}") for k in range(1, levels + 1)] + [(f"b{k}.run", f"(s.i // {RUN ** (k - 1)}) % {RUN}") for k in range(1, tops + 1)]
    joins = " ".join(f"JOIN a{k} ON a{k}.t = l.t AND a{k}.i = l.i // {RUN**k}" for k in range(1, levels + 1)) + " JOIN s ON s.name = l.t " + " ".join(f"JOIN b{k} ON b{k}.i = s.i // {RUN**k}" for k in range(1, tops + 1))
    proof = " || ".join(f"coalesce(array_to_string(list_filter({r}, lambda x, j: j <> {p} + 1), ''), '')" for r, p in runs)
    folds = []
    for k in range(len(runs)):
        folds.append(f"f{k} AS (SELECT *, CASE WHEN len(r{k}) = 0 THEN {'y' if k == 0 else f'y{k - 1}'} ELSE sha256(array_to_string(list_transform(r{k}, lambda x, j: CASE WHEN j = p{k} + 1 THEN {'y' if k == 0 else f'y{k - 1}'} ELSE x END), '')) END AS y{k} FROM {'p' if k == 0 else f'f{k - 1}'})")
    picked = ", ".join(f"{r} AS r{k}, {p} AS p{k}" for k, (r, p) in enumerate(runs))
    return f"""
WITH crc AS (SELECT list_transform(range(256), lambda k: list_reduce(list_prepend(k, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
d AS (SELECT *, coalesce(xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT)), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 5 = 0, false) AS hit FROM documents, crc),
h AS (SELECT doc_id, coalesce('s' || source, 'n') AS t, sha256({facts} || {told("text")}) AS h, sha256({facts} || {told(f"CASE WHEN hit THEN translate(text, '{UPPER}', '{LOWER}') ELSE text END")}) AS y FROM d),
l AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY t) AS n FROM h),
{_levels("l", "a", levels)},
s AS (SELECT '' AS t, t AS name, h, row_number() OVER (ORDER BY encode(t)) - 1 AS i, count(*) OVER () AS n FROM a{levels}),
{_levels("s", "b", tops)},
p AS (SELECT l.doc_id, l.h AS leaf, l.y, s.h AS subroot, b{tops}.h AS root, sha256({proof}) AS proof_sha256, {picked} FROM l {joins}),
{", ".join(folds)}
SELECT doc_id, leaf, subroot, root, proof_sha256, y{len(runs) - 1} AS folded_root, y{len(runs) - 1} = root AS verified FROM f{len(runs) - 1}
"""


ORACLE = oracle()
