import random

import numpy as np
import pytest

from amperflow.llm import neardup as N
from amperflow.llm import shingles


def brute_sets(text, n):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(rows, n=4):
    sets = [brute_sets(t, n) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and both * 100 >= 80 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None] if sets[i] else [d]
        least = min((x for x in ids if x is not None), default=None)
        out.append((d, len(sets[i]), least, d is not None and d == least))
    return out


def corpus():
    rng = random.Random(12)
    vocab = [f"W{k}é" for k in range(500)]
    base = [rng.choices(vocab, k=rng.randint(30, 160)) for _ in range(12)]
    rows = [(k, " ".join(b)) for k, b in enumerate(base)]
    for k in range(170):  # near copies at all distances, chains among them
        w = list(rng.choice(rows)[1].split(" "))
        for _ in range(rng.randint(0, max(1, len(w) // 22))):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        rows.append((1000 - k, rng.choice([" ", "\n", " \t"]).join(w)))
    rows += [(2000, None), (2001, ""), (2002, " \n "), (2003, "two words"), (2004, "Two  WORDS\n"), (2005, "one"), (2006, "a\x85b c d"), (None, rows[3][1]), (None, "alone here we stand now"), (2007, rows[5][1]), (5, rows[5][1]), (5, rows[5][1]), (2000, rows[0][1])]
    return rows


def test_shingles_as_sets():
    texts = [t or "" for _, t in corpus()]
    raw = [t.encode() for t in texts]
    ends = np.cumsum([0, *map(len, raw)])
    hashes, bounds = shingles.shingle_hashes(np.frombuffer(b"".join(raw), np.uint8), ends, 4)
    sets = [brute_sets(t, 4) for t in texts]
    assert np.diff(bounds).tolist() == [len(s) for s in sets]
    own = [set(hashes[a:b].tolist()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    for i in range(0, len(sets), 3):
        for j in range(0, len(sets), 5):
            assert len(own[i] & own[j]) == len(sets[i] & sets[j])


def test_parity_never_prunes_a_link():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 62, 400).astype(np.uint64)
    for k in range(1, 90, 8):
        both = np.concatenate([np.unique(a), np.unique(np.concatenate([a[k:], rng.integers(0, 1 << 62, k).astype(np.uint64)]))])
        n = len(np.unique(a))
        x = N.parities(both, np.array([0, n, len(both)]))
        differ = sum(int(v).bit_count() for v in (x[0] ^ x[1]).view(np.uint64))
        assert differ <= len(np.setxor1d(both[:n], both[n:]))


@pytest.mark.parametrize("side", [256, 2])
def test_groups(spark, monkeypatch, side):
    monkeypatch.setattr(N, "SIDE", side)  # a large bucket meets in blocks of so many nodes
    rows = corpus()
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], "doc_id long, text string, kept string, component_id int").repartition(5)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in N.assign_groups(df).collect()), key=str)
    assert got == sorted(brute(rows), key=str)


def test_one_of_each_stays(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, kept string").repartition(3)
    kept = N.drop_near_duplicates(df, 4)
    assert kept.columns == df.columns
    want = {(d, c) for d, n, c, k in brute(rows) if k and n}
    got = [r.doc_id for r in kept.collect() if (r.text or "").split() and r.doc_id is not None]
    assert sorted(got) == sorted(d for d, _ in want)
    assert {2000, 2001, 2002} <= {r.doc_id for r in kept.collect()}
    assert N.drop_near_duplicates(df.limit(0)).count() == 0


def test_sets_of_null_ids(spark):
    words = [f"w{k}" for k in range(80)]
    alone, shared = " ".join(words), " ".join(reversed(words))
    rows = [(None, alone), (1, alone + " more"), (None, shared.upper()), (2, shared), (3, shared + " more"), (None, shared + " and")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in N.assign_groups(df).collect()), key=str)
    assert got == sorted(brute(rows), key=str)
    assert [r.doc_id for r in N.drop_near_duplicates(df, 4).orderBy("doc_id").collect()] == [1, 2]


def test_very_long_near_copies(spark):
    rng = random.Random(4)
    long = [f"w{rng.randrange(10**6)}" for _ in range(200_000)]
    copy = list(long)
    for k in range(0, len(copy), 100):
        copy[k] = "changed"
    rows = [(5, " ".join(long)), (3, " ".join(copy)), (4, " ".join(long[:100_000]))]
    got = {r.doc_id: (r.component_id, r.kept) for r in N.assign_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {5: (3, False), 3: (3, True), 4: (4, True)}
