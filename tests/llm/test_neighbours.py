import numpy as np
import pytest
from pyspark.sql import functions as F

from amperflow.llm import neighbours as N


def brute(rows, top=10, every=100):
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    out = {}
    for k, (i, v) in enumerate(zip(ids, x, strict=True)):
        if i % every == 0:
            d = np.sqrt(((x - v) ** 2).sum(axis=1))
            order = [j for j in np.lexsort((ids, d)) if j != k][:top]
            out[int(i)] = [(int(ids[j]), float(d[j])) for j in order]
    return out


def run(spark, rows, extra=()):
    df = spark.createDataFrame([(i, None if v is None else [None if y is None else float(y) for y in v], 1) for i, v in [*rows, *extra]], "vec_id long, embedding array<float>, rank int")
    got = {}
    for r in sorted(N.search(df, F.col("vec_id") % 100 == 0).collect(), key=lambda r: (r.query_id, r["rank"])):
        assert r["rank"] == len(got.setdefault(r.query_id, [])) + 1
        got[r.query_id].append((r.vec_id, r.score))
    return got


def test_recall_and_scores(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((12, 32))
    x = (centres[rng.integers(0, 12, 3000)] + 0.6 * rng.standard_normal((3000, 32))).astype(np.float32)
    x[500:900] = x[500]  # one vector in many rows
    rows = list(enumerate(x))
    want, got = brute(rows), run(spark, rows)
    assert set(got) == set(want) and all(len(v) == 10 for v in got.values())
    hits = [len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want]
    assert sum(hits) / (10 * len(want)) >= 0.9
    assert got[500] == want[500]
    for q in want:
        for (i, d) in got[q]:
            assert abs(d - np.sqrt(((x[i].astype(float) - x[q].astype(float)) ** 2).sum())) < 1e-12


def test_small_tables_are_exact(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(-2, 3, (60, 3)).astype(np.float32)
    x[(x == 0).all(axis=1)] = 1
    rows = list(enumerate(x))
    extra = [(1000, None), (1100, [0, 0, 0]), (1200, [1, None, 2]), (1300, [float("nan"), 1, 2]), (1400, [1, 2]), (None, [1, 1, 1]), (1500, [float("inf"), 0, 1])]
    want, got = brute(rows), run(spark, rows, extra)
    assert got == {q: [(i, pytest.approx(d)) for i, d in v] for q, v in want.items()}


def test_few_and_none(spark):
    assert run(spark, [(0, [1.0, 2.0]), (1, [1.0, 3.0])]) == {0: [(1, 1.0)]}
    assert run(spark, [(0, [1.0, 2.0])]) == {}
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert N.search(df, F.col("vec_id") % 100 == 0).count() == 0


def test_one_far_vector_leaves_the_others_apart(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((2000, 16)).astype(np.float32)
    x[7] *= 1e9
    rows = list(enumerate(x))
    want, got = brute(rows), run(spark, rows)
    hits = [len({i for i, _ in got.get(q, [])} & {i for i, _ in want[q]}) for q in want]
    assert sum(hits) / (10 * len(want)) >= 0.9


def test_rounds_of_descent_find_what_blocks_missed(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 128)
    monkeypatch.setattr(N, "TABLES", 3)
    rng = np.random.default_rng(8)
    centres = 3 * rng.standard_normal((40, 24))
    x = (centres[rng.integers(0, 40, 4000)] + rng.standard_normal((4000, 24))).astype(np.float32) + 1000  # a common offset
    rows = list(enumerate(x))
    want, got = brute(rows), run(spark, rows)
    hits = [len({i for i, _ in got.get(q, [])} & {i for i, _ in want[q]}) for q in want]
    assert sum(hits) / (10 * len(want)) >= 0.9


def test_queries_of_one_vector_are_one_search(spark):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((1200, 8)).astype(np.float32)
    x[::3] = x[0]
    rows = list(enumerate(x))
    assert {q: v for q, v in run(spark, rows).items() if q % 300 == 0} == {q: v for q, v in brute(rows).items() if q % 300 == 0}
