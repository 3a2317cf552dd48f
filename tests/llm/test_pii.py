import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from amperflow.llm import pii as P


def luhn(s):
    return sum(d if k % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2) for k, d in enumerate(map(int, reversed(s)))) % 10 == 0


def brute(t):
    found = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    found += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    digits = lambda s: re.sub("[^0-9]", "", s)
    found += [("card", m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 12 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    found += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m[0])) <= 15]
    order = {k: i for i, k in enumerate(P.KINDS)}
    found.sort(key=lambda x: (x[1], order[x[0]]))
    return *(sum(k == x[0] for x in found) for k in P.KINDS), hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in found).encode()).hexdigest()


CASES = [
    None, "", "é😀 bosbt.42@mail8.example.com x", "a@b.cx_y@d.e.f@g.h", "a@b", "55.63.178.142 256.1.1.1 1.2.3.4.5.6.7.8 0255.001.000.00001", "4387513035237269 4111-1111 1111 1111 4111111111111112",
    "+1 (988) 555-2485 orthen +12 34 +1 222 333 444 555 666 777", "1" * 3000, "+" + "1 " * 3000, "@" * 3000, "a" * 20000 + "@x.yy", "1.1.1.1 " * 400, "9" * 19 + ".1.1.1",
]


def texts(n=200):
    rng = random.Random(4)
    parts = ["a", "@", ".", "b.c", "1", "23", "255", "4111111111111111", " ", "-", "+", "(5", ")", "x_y", "é", "%", "\n", "999"]
    return CASES + ["".join(rng.choices(parts, k=rng.randint(1, 50))) for _ in range(n)]


def test_base_spans(spark):
    rows = texts()
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(rows)], "doc_id long, text string, n_email int")
    got = {r.doc_id: (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in P.scan_personal(docs).collect()}
    assert got == {k: brute(t or "") for k, t in enumerate(rows)}


def test_features_alike(spark):
    rng = random.Random(8)
    rows = [("".join(rng.choices("0123456789 .-()/ab@", k=rng.randint(7, 30))), rng.choice(["phone ", "order ", "x", "née le ", "Téléphone "]), "y") for _ in range(60)]
    df = spark.createDataFrame(rows, "m string, b string, a string")
    for r in df.select("m", "b", "a", F.array(*P.feature_columns(F.col("m"), F.col("b"), F.col("a"))).alias("f")).collect():
        assert r.f == P.features(r.m, r.b, r.a), r.m


def scored(m, before, after=" x"):
    trees, (a, b), threshold = P.model()
    v = P.features(m, before, after)
    return 1 / (1 + np.exp(-(a * P.RATE * sum(P.tree_value(t, v) for t in trees) + b))) >= threshold


def test_trees_separate():
    trees, (a, b), threshold = P.model()
    x, y = P.examples(2000, 9)
    p = 1 / (1 + np.exp(-(a * np.array([P.RATE * sum(P.tree_value(t, v) for t in trees) for v in x]) + b)))
    assert y[p >= threshold].mean() > 0.98 and ((p >= threshold) & (y > 0)).sum() > 0.95 * y.sum()


def test_context_decides_where_formats_are_shared():
    for m, before in [("07700 900123", "phone "), ("0171-5551234", "Telefon "), ("2125550187", "call "), ("212 555 0187", "reach me at "), ("1980-05-17", "born "), ("12345678", "Konto "), ("06 12 34 56 78", "téléphone ")]:
        assert scored(m, before), (m, before)
    for m, before in [("123-45-6789", "order "), ("2125550187", "on "), ("212 555 0187", "of "), ("2024-01-31", "on "), ("12345678", "page "), ("1.20.3000", "version "), ("4330768677250263", "in ")]:
        assert not scored(m, before), (m, before)


def test_probabilities_of_spark_and_numpy_agree(spark):
    trees, (a, b), _ = P.model()
    x, _ = P.examples(40, 12)
    got = spark.createDataFrame([(v.tolist(),) for v in x], "v array<double>").select(P.probability(F.col("v")).alias("p")).collect()
    for r, v in zip(got, x, strict=True):
        assert abs(r.p - 1 / (1 + np.exp(-(a * P.RATE * sum(P.tree_value(t, v) for t in trees) + b)))) < 1e-9


def test_added_spans(spark):
    rows = ["please call (212) 555-0187 now", "ssn 123-45-6789 ok", "write to john (at) acme (dot) com today", "on 2024-01-31 version 1.20.3000 order 1234567", "page 12 34 567 total", "iban DE89 3704 0044 0532 0130 00 ok"]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in P.scan_personal(docs).collect()}
    assert got[0] == "scored:12:26" and got[1] == "scored:4:15" and got[2].startswith("scored:") and "scored:5:32" in got[5]
    assert got[3] == "" and got[4] == ""
    assert P.redact_personal(docs).where("doc_id = 1").first().text == "ssn [PII] ok"
    assert P.scan_personal(docs.limit(0)).count() == 0


def test_likeliest_of_overlapping(spark):
    spans = [(0, 5, "a", 0.9), (3, 9, "b", 0.95), (8, 12, "c", 0.7), (12, 15, "d", 0.8), (20, 22, "e", 0.5), (20, 23, "f", 0.5)]
    df = spark.createDataFrame([(spans,), ([],)], "x array<struct<s:int,e:int,m:string,p:double>>")
    got = [[x.m for x in r[0]] for r in df.select(P.likeliest(F.col("x"))).collect()]
    assert got == [["b", "d", "e"], []]
    chain = [(0, 5, "a", 0.95), (3, 9, "b", 0.9), (8, 12, "c", 0.94)]
    df = spark.createDataFrame([(chain,)], "x array<struct<s:int,e:int,m:string,p:double>>")
    assert [x.m for x in df.select(P.likeliest(F.col("x"))).first()[0]] == ["a", "c"]
    # Against the plain loop, over long and short chains.
    rng, rows = random.Random(6), []
    for _ in range(60):
        spans = [(s, s + rng.randint(1, 9), f"m{k}", rng.choice([0.5, 0.6, 0.7, 0.8, 0.9])) for k, s in enumerate(rng.randint(0, 60) for _ in range(rng.randint(1, 25)))]
        rows.append(spans)
    got = spark.createDataFrame([(k, x) for k, x in enumerate(rows)], "k int, x array<struct<s:int,e:int,m:string,p:double>>").select("k", P.likeliest(F.col("x")).alias("y")).collect()
    for r in got:
        want: list = []
        for x in sorted(rows[r.k], key=lambda x: (-x[3], x[0], x[1], x[2])):
            if all(x[0] >= y[1] or y[0] >= x[1] for y in want):
                want.append(x)
        assert [tuple(y) for y in r.y] == sorted(x[:3] for x in want)


def test_neighbours_are_proposed_alone_too(spark):
    rows = ["phone 2125550187 4155550123", "call 212-555-0187 415-555-0123", "phone 2125550187"]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in P.scan_personal(docs).collect()}
    assert got == {0: "scored:6:16,scored:17:27", 1: "scored:5:17,scored:18:30", 2: "scored:6:16"}


def test_very_long_texts(spark):
    rows = ["1 " * 500_000 + "x", "a@b.cc " * 20_000, "x.y." * 300_000, "call 0171-5551234, " * 2_000 + "z" * 500_000]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: r for r in P.scan_personal(docs).collect()}
    assert got[0].spans == ""
    assert got[1].n_email == 20_000 and got[3].spans.count("scored") == 2_000
    assert P.redact_personal(docs).where("doc_id = 1").first().text == "[PII] " * 20_000
