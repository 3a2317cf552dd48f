import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from amperflow.llm import shards


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 8, 100, 1000, 4097])
def test_permutation(n):
    out = shards.feistel(np.arange(n, dtype=np.uint64), n)
    assert sorted(out.tolist()) == list(range(n))
    if n > 10:
        assert out.tolist() != list(range(n))
        assert [shards.place(k, n) for k in range(10)] == [(p % 8, p // 8) for p in out[:10].tolist()]


def test_rows_law(spark):
    rows = [(k, f"text {k} é" * (k % 5)) for k in range(333)] + [(None, None), (None, "x"), (5, "same")] + [(7, "again")] * 50
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, shard string")
    out = shards.assign_shards(df).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows)
    slots = defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    sizes = [len(slots[k]) for k in range(8)]
    assert max(sizes) - min(sizes) <= 1
    # Another partitioning of the same rows gives the same places.
    again = shards.assign_shards(df.repartition(7, "text")).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, out))


def test_empty(spark):
    assert shards.assign_shards(spark.createDataFrame([], "doc_id long, text string")).count() == 0
