import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from amperflow.llm import substrings as R
from amperflow.llm import suffixes as S


def test_suffix_arrays():
    rng = np.random.default_rng(0)
    for trial in range(300):
        a = rng.integers(0, rng.integers(1, 5) + 1, rng.integers(1, 60)).astype(np.uint8)
        if trial % 7 == 0:
            a = np.tile(a[:3], 20)
        b = a.tobytes()
        order = S.suffix_array(a)
        assert order.tolist() == sorted(range(len(a)), key=lambda i: b[i:])  # noqa: B023
        shared = S.permuted_prefixes(a, order, 10)
        for x, y in zip(order[1:].tolist(), order[:-1].tolist(), strict=True):
            k = 0
            while k < 10 and max(x, y) + k < len(b) and b[x + k] == b[y + k]:
                k += 1
            assert shared[x] == k
    assert len(S.suffix_array(np.empty(0, np.uint8))) == 0


def brute(rows, k=50):
    raw = [(t or "").encode() for _, t in rows]
    ids = [d if d is not None else 1 << 63 for d, _ in rows]
    least = defaultdict(lambda: 1 << 64)
    for d, b in zip(ids, raw, strict=True):
        for i in range(len(b) - k + 1):
            least[b[i : i + k]] = min(least[b[i : i + k]], d)
    out = []
    for (doc, _), d, b in zip(rows, ids, raw, strict=True):
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - k + 1):
            if least[b[i : i + k]] < d:
                gone[i : i + k] = True
        kept = bytes(c for c, g in zip(b, gone, strict=False) if not g)
        spans = int(np.count_nonzero(np.diff(gone.astype(int)) == 1) + gone[0])
        out.append((doc, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdeé ", k=rng.randint(2, 7)))
    some = lambda n: " ".join(word() for _ in range(n))
    passages = [some(rng.randint(8, 60)) for _ in range(12)] + ["x" * 200, "ab" * 90, some(9).ljust(50, ".")[:50], some(9).ljust(51, "!")[:51]]
    rows = []
    for k in range(60):
        parts = [some(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p) // 3)
            parts += [p[a : len(p) - rng.randint(0, len(p) // 3)] if rng.random() < 0.5 else p, some(rng.randint(0, 6))]
        rows.append((k * 3 % 61, "".join(parts)))
    rows += [rows[4], (100, rows[4][1]), (101, rows[5][1] + "tail"), (102, None), (103, ""), (104, "y" * 49), (105, "y" * 49), (106, "z" * 50), (None, rows[7][1]), (None, rows[7][1]), (4, rows[8][1])]
    return rows


@pytest.mark.parametrize("block", [1500, 24 << 20])
def test_removals(spark, monkeypatch, block):
    rows = corpus(block % 7)
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, spans string").repartition(4)
    monkeypatch.setattr(R, "BLOCK", block)
    got = sorted((tuple(r) for r in R.remove_repeats(df).collect()), key=str)
    assert got == sorted(brute(rows), key=str)


def test_empty(spark):
    assert R.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_text_of_more_than_four_megabytes(spark):
    rng = random.Random(8)
    long = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz é", k=4_400_000))
    rows = [(1, long), (2, "before " + long[4_200_000:4_201_000] + " after"), (3, long[100:160])]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in R.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    size = lambda s: len(s.encode())
    assert got == {1: (size(long), 0, 0), 2: (size(rows[1][1]), size(long[4_200_000:4_201_000]), 1), 3: (size(rows[2][1]), size(rows[2][1]), 1)}


def test_positions_to_the_end_of_the_longest_text():
    first, count, own = np.array([0, (1 << 31) - 1]), np.array([1, 35]), np.array([R.OWN, 5])
    big = np.array([1 << 63, 3], np.uint64)
    _, _, y = R.pack(first, count, own, big, big, big, big)
    assert [v.tolist() for v in R.unpack_y(y)] == [first.tolist(), count.tolist(), own.tolist()]
