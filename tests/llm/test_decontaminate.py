import random
import re

from amperflow.llm import decontaminate as D


def words(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def brute(docs, items, n=5, threshold=80):
    found = {}
    for item, text in items:
        w = words(text)
        k = min(n, len(w))
        if not k:
            continue
        s = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
        for doc, body in docs:
            b = words(body)
            shared = len(s & {tuple(b[i : i + k]) for i in range(len(b) - k + 1)})
            if shared * 100 >= threshold * len(s):
                found[doc, item] = (len(s), shared)
    return found


def tables():
    rng = random.Random(6)
    vocab = [f"w{k}" for k in range(200)]
    some = lambda n: rng.choices(vocab, k=n)
    items = [(k, " ".join(some(rng.choice([2, 5, 6, 9, 14, 30, 60])))) for k in range(40)] + [(90, ""), (91, None), (92, "..."), (None, "Nul Item, of six plain WORDS")]
    docs = [(k, " ".join(some(rng.randint(0, 300)))) for k in range(80)] + [(200, None), (201, ""), (202, "x nul item of six plain words y"), (None, "nul item of six plain words")]
    for k in range(60):
        w = rng.choice(items[:40])[1].split()
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = "changed"
        docs.append((300 + k, " ".join(some(rng.randint(0, 400))) + "\n" + ", ".join(w).upper() + " " + " ".join(some(50))))
    return docs + docs[-3:], items


def test_all_pairs_and_no_more(spark):
    docs, items = tables()
    d = spark.createDataFrame([(*x, "c") for x in docs], "doc_id long, text string, item_id string")
    i = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    for rows in (200_000, 0):
        got = {(r.doc_id, r.item_id): (r.n_item, r.n_shared) for r in D.contained_items(d, i, broadcast_rows=rows).collect()}
        assert got == want
    kept = [r.doc_id for r in D.drop_contaminated(d, i).collect()]
    assert sorted(str(k) for k in kept) == sorted(str(k) for k, _ in docs if k not in {a for a, _ in want})


def test_empty(spark):
    d = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    i = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert D.contained_items(d.limit(0), i).count() == 0 and D.contained_items(d, i.limit(0)).count() == 0
    assert D.drop_contaminated(d, i.limit(0)).count() == 1


def test_an_item_in_a_very_long_text(spark):
    rng = random.Random(2)
    long = [f"w{rng.randrange(5000)}" for _ in range(300_000)]
    item = [f"v{k}" for k in range(12)]
    docs = spark.createDataFrame([(1, " ".join(long[:150_000] + item + long[150_000:])), (2, " ".join(long))], "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(item)), (8, " ".join(item[:11]) + " other words")], "item_id long, text string")
    assert [(r.doc_id, r.item_id, r.n_shared) for r in D.contained_items(docs, items).collect()] == [(1, 7, 8)]
    assert [r.doc_id for r in D.drop_contaminated(docs, items).collect()] == [2]
