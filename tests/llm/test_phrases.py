import re
from collections import Counter

import numpy as np
import pytest

from amperflow.llm import phrases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, top):
    f, total = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            w = [x for x in re.split("[ \t]+", piece) if x]
            total[lang] += len(w)
            f.update((lang, *w[i : i + n]) for n in range(1, 5) for i in range(len(w) - n + 1))
    found = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    out = []
    for (lang, *w), a in found.items():
        score, k = min((2_000_000 * a // (f[lang, *w[:k]] + f[lang, *w[k:]]), k) for k in range(1, len(w)))
        inside = lambda q: any(list(q[s : s + len(w)]) == w for s in range(1, len(q) - len(w) + 1))  # noqa: E731, B023
        if not any(len(q) - 1 > len(w) and q[0] == lang and inside(q) and 100 * b >= 80 * a for q, b in found.items()):
            out.append((lang, -score, -a, " ".join(w).encode(), f[lang, *w[:k]], f[lang, *w[k:]]))
    out.sort()
    ranks = Counter()
    rows = []
    for lang, score, a, phrase, left, right in out:
        ranks[lang] += 1
        if ranks[lang] <= top:
            rows.append((lang, ranks[lang], phrase.decode(), -a, left, right, total[lang], -score))
    return rows


def texts(n):
    r = np.random.default_rng(n)
    words = [f"w{k}" for k in range(12)] + ["Élan", "É", "ÉLAN", "\x00", "\xa0", "日本", "A", "a"]
    return [(None if k % 40 == 0 else "".join(r.choice(words) + r.choice([" ", " ", " ", "\t ", ".", "\n", " ,"]) for _ in range(r.integers(0, 60))), r.choice([None, "en", "fr", "und"])) for k in range(n)]


@pytest.mark.parametrize("shard", [100, 3000, phrases.SHARD])
def test_brute_force(spark, shard):
    rows = [*texts(200), *[("one two three four five six", "en")] * 40, ("", "en"), ("...", None), ("same same same same same same same", "fr")]
    df = spark.createDataFrame([(t, lang if lang is None else str(lang), 1, "x") for t, lang in rows], "text string, lang string, n int, phrase string").repartition(3)
    got = sorted(tuple(r) for r in phrases.collocations(df, least=5, top=30, shard=shard).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())
    assert got == sorted(brute(rows, 5, 30))
    # A filter that is full lets every phrase through: nothing changes.
    full = sorted(tuple(r) for r in phrases.collocations(df, least=5, top=30, shard=shard, bits=8192).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())
    assert full == got


def test_suffix_array():
    r = np.random.default_rng(1)
    ids = r.integers(0, 4, 500)
    order, lcp = phrases.suffixes(ids, 4)
    at = [tuple(ids[p : p + 4]) for p in order]
    assert at == sorted(at) and sorted(order.tolist()) == list(range(500))
    for k in range(1, 500):
        a, b = (np.append(ids, np.zeros(4, int))[p : p + 4] for p in order[k - 1 : k + 1])
        same = a == b
        assert lcp[k] == (4 if same.all() else int(np.argmin(same)))


def test_long_text(spark):
    """A text far longer than a shard is cut where pieces end: no phrase is lost, and none arises over a cut."""
    text = "alpha beta gamma. " * 20_000
    out = phrases.collocations(spark.createDataFrame([(text, "en")], "text string, lang string"), shard=5000).collect()
    assert [(r.phrase, r.a, r.l, r.r, r.n, r.score) for r in out] == [("alpha beta gamma", 20_000, 20_000, 20_000, 60_000, 1_000_000)]


def test_beyond_64_bits(spark):
    a = 9_000_000_000_000_000_000
    df = spark.createDataFrame([(a,)], "a long")
    assert df.selectExpr("cast(2000000 as decimal(10,0)) * cast(a as decimal(20,0)) div (cast(a as decimal(20,0)) + cast(a as decimal(20,0))) AS s").first().s == 1_000_000


def test_empty(spark):
    assert phrases.collocations(spark.createDataFrame([], "text string, lang string")).count() == 0
    assert phrases.collocations(spark.createDataFrame([(None, None), ("", "en")], "text string, lang string")).count() == 0
