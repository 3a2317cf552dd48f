import hashlib

import numpy as np
import pytest

import corpus_pipeline as C
from amperflow.llm import bpe

from .test_decontaminate import brute as leaks
from .test_neardup import brute as groups
from .test_secrets import ASSIGN

SAMPLE = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SAMPLE}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    state, seen = docs, []
    for name, stage in C.STAGES:
        state = stage(spark, state, SAMPLE)
        state = C.written(state, name)
        seen.append({r.doc_id: r for r in state.collect()})
        assert len(seen[-1]) == state.count()
        if name != "bpe_encoding":
            assert state.columns == docs.columns
    lettered = {d for d, r in rows.items() if any(c.isalpha() for c in r.text or "")}
    assert set(seen[0]) == lettered
    alone = groups([(d, rows[d].text) for d in sorted(lettered)], 5)
    assert set(seen[1]) == {d for d, n, c, kept in alone if kept}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SAMPLE}/benchmark.parquet").collect()]
    bad = {d for d, _ in leaks([(d, rows[d].text) for d in seen[1]], items)}
    assert set(seen[2]) == set(seen[1]) - bad
    assert set(seen[3]) == set(seen[2])
    for d, r in seen[3].items():
        assert not any(len(m[2]) >= 12 for m in ASSIGN.finditer(r.text)) and r.n_chars == len(r.text)
        if "[SECRET]" not in r.text:
            assert r.text == rows[d].text
    with open(bpe.default_vocabulary(), encoding="utf-8") as f:
        codec = bpe.Codec(f.read())
    for d, r in seen[4].items():
        ids = codec.full.encode(seen[3][d].text, add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(seen[3][d].text.encode()).hexdigest()


@pytest.mark.parametrize("rows", [[], [(1, "a b c d e f", "en", "s", 11), (1, "a b c d e f", "en", "s", 11), (None, "zz", None, None, 2), (2, "", "en", "s", 0)]])
def test_odd_tables(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in C.STAGES:
        docs = stage(spark, docs, SAMPLE)
    assert docs.count() == (2 if len(rows) == 4 else 0)


def test_the_language_found_decides_and_is_handed_on(spark):
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in spark.read.parquet(f"{SAMPLE}/documents.parquet").collect()]
    given = {r[0]: r[2] for r in rows}
    unnamed = {r[0] for r in rows[::7]}
    rows = [(d, t, None if d in unnamed else lang, s, n) for d, t, lang, s, n in rows]
    mixed = (10**6, "".join(t[:400] for lang in ("de", "en", "es", "fr") for _, t, x, _, _ in [next(r for r in rows if r[2] == lang and len(r[1]) > 400)]), None, "s", 1600)
    docs = spark.createDataFrame([*rows, mixed], "doc_id long, text string, lang string, source string, n_chars long")
    kept = C.written(C.language_id(spark, docs, SAMPLE), "language")
    found = {r.doc_id: r.lang for r in kept.collect()}
    assert mixed[0] not in found and found == {d: x for d, x in given.items() if d in found} and len(found) >= len(given) - 2
    assert unnamed & set(found)
    assert {r.doc_id: r.lang for r in C.bpe_encoding(spark, kept, SAMPLE).collect()} == found
