import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from amperflow.llm import lines

BLANK = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    """doc_id, lines, dropped lines and kept text, by dictionaries."""
    rank = lambda d: (d is None, d or 0)
    key = lambda x: x.strip(BLANK).translate(LOWER)
    held = defaultdict(set)
    for d, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 10:
                held[key(x)].add(rank(d))
    out = []
    for d, t in rows:
        every = (t or "").split("\n")
        kept = [x for x in every if len(held.get(key(x), ())) < 2 or min(held[key(x)]) == rank(d)]
        out.append((d, len(every), len(every) - len(kept), "\n".join(kept)))
    return Counter(out)


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 20_000])
def test_minimal_perfect(n):
    r = np.random.default_rng(n)
    a, b = r.integers(0, 1 << 63, n, np.uint64), r.integers(0, 1 << 63, n, np.uint64)
    a[: n // 3] = 7  # halves may agree
    index = lines.LineIndex.unpacked(lines.LineIndex.built(a, b, np.arange(n) % 5, np.arange(n)).packed())
    at, known = index.places(a, b)
    assert known.all() and sorted(at.tolist()) == list(range(n))
    counts, owners = index.found(a, b)
    assert counts.tolist() == (np.arange(n) % 5).tolist() and owners.tolist() == list(range(n))
    others, _ = index.found(b + np.uint64(1), a)
    assert not others.any()


ROWS = [
    (1, "the first shared line\nown line of one\n short \n\nlast"), (2, "THE first shared line \nother\n\tthe first shared line"), (3, "own line of one\x0b\nä long line with ÄÖ\nx"),
    (4, "Ä long line with ÄÖ\nä long line with ÄÖ\r"), (5, None), (6, ""), (7, "\n\n"), (8, "exactly te\nexactly t"), (9, "exactly te\nexactly t"), (9, "second text of nine\nexactly te"),
    (9, "second text of nine\nexactly te"), (None, "no id has this line\nno id has this line"), (None, "the first shared line"), (10, "twice in itself\ntwice in itself"), (-5, "negative ids come first"), (11, "negative ids come first"),
]


@pytest.mark.parametrize("per_shard", [1, 8192])
def test_brute_force(spark, per_shard):
    df = spark.createDataFrame([(*r, 3, "x") for r in ROWS], "doc_id long, text string, n_lines int, `index` string")
    out = Counter(tuple(r) for r in lines.drop_repeated_lines(df, per_shard).select("doc_id", "n_lines", "n_dropped", "kept").collect())
    assert out == brute(ROWS)


def test_hot_line_and_long_text(spark):
    rows = [(k, f"a line that a third of all share\nline number {k}") for k in range(3000)] + [(9000, "\n".join(f"long text line {k % 5000}" for k in range(60_000)))]
    rows += [(9001, "long text line 17\nz" * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    index, shards = lines.index_lines(df, 64)
    assert index.count() <= shards and shards > 50
    got = Counter((r.doc_id, r.n_lines, r.n_dropped, hashlib.md5(r.kept.encode()).hexdigest()) for r in lines.drop_repeated_lines(df, 64).collect())
    assert got == Counter((d, n, k, hashlib.md5(t.encode()).hexdigest()) for (d, n, k, t), c in brute(rows).items() for _ in range(c))


def test_other_documents(spark):
    """An index serves documents that it was not built over."""
    index, shards = lines.index_lines(spark.createDataFrame([(1, "common boilerplate"), (2, "common boilerplate"), (3, "known from one alone")], "doc_id long, text string"))
    gone = lines.repeated_lines(spark.createDataFrame([(7, "fresh words\nCommon boilerplate\nknown from one alone")], "doc_id long, text string"), index, shards)
    assert [(r.doc_id, r["at"]) for r in gone.collect()] == [(7, 1)]


def test_empty(spark):
    assert lines.drop_repeated_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0
