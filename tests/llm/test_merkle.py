import hashlib
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from amperflow.llm import merkle

H = lambda s: hashlib.sha256(s.encode()).hexdigest()
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H("".join(out[-1][k : k + 16])) for k in range(0, len(out[-1]), 16)])
    return out


def path(tree, k):
    found = []
    for level in tree[:-1]:
        run = level[k // 16 * 16 : k // 16 * 16 + 16]
        found.append((run[: k % 16], run[k % 16 + 1 :]))
        k //= 16
    return found


def brute(rows):
    told = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    trees = defaultdict(list)
    for doc, text, lang, source, n in rows:
        hit = doc is not None and zlib.crc32(str(doc).encode()) % 5 == 0
        other = text.translate(LOWER) if hit and text is not None else text
        leaf = lambda t: H("".join(map(told, (doc, source, lang, n, t))))  # noqa: E731, B023
        trees[source].append(((doc is not None, doc or 0), leaf(text), leaf(other), doc))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    made = {s: levels([x[1] for x in sorted(trees[s])]) for s in order}
    top = levels([made[s][-1][0] for s in order])
    out = []
    for j, s in enumerate(order):
        for k, (_, leaf, other, doc) in enumerate(sorted(trees[s])):
            way = path(made[s], k) + path(top, j)
            x = other
            for before, after in way:
                x = H("".join(before) + x + "".join(after))
            out.append((doc, leaf, made[s][-1][0], top[-1][0], H("".join("".join(b) + "".join(a) for b, a in way)), x, x == top[-1][0]))
    return Counter(out)


def checked(spark, rows, partitions=3):
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, tree string").repartition(partitions)
    got = Counter(tuple(r) for r in merkle.manifest(df, merkle.tampered_text()).collect())
    assert got == brute(rows)
    return got


@pytest.mark.parametrize("n", [1, 2, 16, 17, 257])
def test_one_source(spark, n):
    checked(spark, [(k * 3, f"Text {k}", "en", "s", k) for k in range(n)])


def test_edges(spark):
    rows = [(k, f"Some TEXT é {k}", None if k % 7 == 0 else "en", None if k % 9 == 0 else f"s{k % 40}", None if k % 5 == 0 else k) for k in range(500)]
    rows += [(3, "again", "en", "s1", 1), (3, "again", "en", "s1", 1), (3, "other", "en", "s1", 1), (None, "None", None, None, None), (None, None, None, "s2", None), (600, None, "en", "", 0), (601, "", "en", "n", 0)]
    rows += [(700 + k, "Y" * k, "de", "é", k) for k in range(20)]
    got = checked(spark, rows)
    assert any(not r[-1] for r in got) and any(r[-1] for r in got)


def test_repeated_rows(spark):
    checked(spark, [(5, "the same", "en", "s", 8)] * 300 + [(6, "Z" * 300_000, "en", "s", 1)])


def test_two_walks(spark):
    """A source of more than 4,096 leaves, beside small ones."""
    checked(spark, [(k, f"T{k}", "en", "big" if k % 10 else f"s{k % 30}", k) for k in range(5200)], 4)


def test_many_sources(spark):
    checked(spark, [(k, f"T{k}", "en", f"s{k}", k) for k in range(4200)], 4)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert merkle.manifest(df, F.col("text")).count() == 0
