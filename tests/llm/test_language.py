import random
import zlib

import numpy as np

from amperflow.llm import language as L


def corpus(n=260):
    rng = random.Random(2)
    words = {"aa": ["thing", "where", "and", "the"], "bb": ["über", "und", "nicht", "schon"], "cc": ["où", "très", "dans", "chose"]}
    rows = []
    for k in range(n):
        lang = rng.choice(list(words))
        rows.append((k, " ".join(rng.choices(words[lang], k=rng.randint(4, 60))), lang))
    return rows


def test_gradients():
    net = L.Network(["a", "b", "c"], units=4)
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 256, (9, 5)), np.array([0, 1, 2, 1, 0])
    _, grad = net.gradients(x, y)
    for name, g in grad.items():
        place = np.unravel_index(np.abs(g).argmax(), g.shape)
        old = net.p[name][place]
        net.p[name][place] = old + 1e-2
        up, _ = net.gradients(x, y)
        net.p[name][place] = old - 1e-2
        down, _ = net.gradients(x, y)
        net.p[name][place] = old
        assert abs((up - down) / 2e-2 - g[place]) < 2e-3 + 0.05 * abs(g[place]), name


def test_pooling_covers_whole_texts():
    net = L.Network(["a", "b"], units=4)
    raw = [b"abc" * 200, b"", b"x", b"y" * 64, b"z" * 65]
    ends = np.cumsum([0, *map(len, raw)])
    p = net.documents(np.frombuffer(b"".join(raw), np.uint8), ends, rows=3)
    assert p.shape == (5, 2) and np.allclose(p.sum(axis=1), 1, atol=1e-5)
    for k, b in enumerate(raw):
        if b:
            parts = []
            for a in range(0, len(b), L.WIDTH):
                w = np.frombuffer(b[a : a + L.WIDTH].ljust(L.WIDTH, b"\0"), np.uint8)
                parts.append(net.positions(w[:, None].astype(np.int64))[: len(b[a : a + L.WIDTH]), 0])
            assert np.allclose(p[k], np.concatenate(parts).mean(axis=0), atol=1e-5)


def test_prediction(spark, monkeypatch):
    monkeypatch.setattr(L, "STEPS", 120)
    rows = corpus() + [(900, None, "aa"), (901, "", "aa"), (902, "12 34 %%", "aa"), (None, "und nicht schon", None), (903, "the thing and where", None), (903, "the thing and where", None)]
    df = spark.createDataFrame([(*r, "clash", 7) for r in rows], "doc_id long, text string, lang string, lang_pred string, score int")
    net = L.train_on(df)
    assert net.languages == ["aa", "bb", "cc"]
    out = L.predict(df, net)
    assert out.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    got = out.collect()
    assert len(got) == len(rows)
    held = [r for r in got if r.doc_id is not None and r.doc_id < 900 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum(r.lang_pred == r.lang for r in held) >= 0.95 * len(held) and all(0 <= r.score <= 1 for r in got)
    assert all(r.lang_pred == "und" for r in got if r.doc_id in (900, 901, 902))
    kept = L.keep_identified(df)
    assert kept.columns == df.columns and kept.count() == len(rows) - 3
    assert {r.lang_pred for r in kept.collect()} == {"clash"}


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in L.predict(df, L.train_on(df)).collect()] == [("und", 0.0)]
    assert L.predict(df.limit(0), L.train_on(df.limit(0))).count() == 0


def test_every_language_is_learned(spark, monkeypatch):
    monkeypatch.setattr(L, "STEPS", 2)
    rows = [(5 * k + j, chr(0x4E00 + k) * 9, f"l{k:03d}") for k in range(70) for j in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = {r[2] for r in rows if zlib.crc32(str(r[0]).encode()) % 5}
    net = L.train_on(df)
    assert len(learned) > 64 and set(net.languages) == learned
    assert {r.lang_pred for r in L.predict(df, net).collect()} <= learned


def test_stage_keeps_text_where_nothing_is_learned(spark):
    rows = [(1, "some text", None), (2, "more", None), (3, "12 %", None), (4, None, None), (5, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert [r.doc_id for r in L.keep_identified(df).orderBy("doc_id").collect()] == [1, 2]
    assert [r.doc_id for r in L.keep_identified(df, 0.5).orderBy("doc_id").collect()] == [1, 2]
    named = df.withColumn("lang", L.F.lit("und"))
    assert [r.doc_id for r in L.keep_identified(named).orderBy("doc_id").collect()] == [1, 2]


def test_query_on_held_out_documents(spark):
    rows = {r.doc_id: r for r in L.op7_recurrent_language(spark, "/root/testdata/sf0.01").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    assert len(rows) == len(docs)
    held = [d for d in docs if zlib.crc32(str(d.doc_id).encode()) % 5 == 0]
    assert all(rows[d.doc_id].held_out == (d in held) for d in docs[:50]) and all(rows[d.doc_id].held_out for d in held)
    told = [d for d in held if d.lang is not None and any(c.isalpha() for c in d.text or "")]
    assert sum(rows[d.doc_id].lang_pred == d.lang for d in told) >= 0.95 * len(told) > 100


def test_the_sample_depends_on_rows_alone(spark):
    df = spark.createDataFrame(corpus(), "doc_id long, text string, lang string")
    counts = {"aa": 10, "bb": 10, "cc": 10}
    one = L.labelled_windows(df.repartition(1), list(counts), counts)
    two = L.labelled_windows(df.repartition(5), list(counts), counts)
    assert all((a == b).all() for a, b in zip(one, two, strict=True))


def test_a_very_long_text_is_read_to_its_end(spark):
    net = L.train_on(spark.createDataFrame(corpus(), "doc_id long, text string, lang string"))
    words = {lang: next(t for _, t, x in corpus() if x == lang) for lang in ("aa", "bb")}
    size = 1_000_000
    text = (words["aa"] + " ") * (size // len(words["aa"])) + (words["bb"] + " ") * (3 * size // len(words["bb"]))
    (row,) = L.predict(spark.createDataFrame([(1, text)], "doc_id long, text string"), net).collect()
    assert row.lang_pred == "bb" and 0.6 < row.score < 0.9
