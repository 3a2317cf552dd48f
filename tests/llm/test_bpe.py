import hashlib
import random

import numpy as np
import pytest

from amperflow.llm import bpe

TEXTS = [None, "", " ", "a", "\n\n  \t x", "Thhe'll of the <|endoftext|> and <|endoftext|>", "naïve çà été ß ñ ÿ \u0085 \xa0 x", "日本語 テキスト 中文 " * 40, "a" * 5000, "word " * 3000, "x́y 😀😀 z " * 50, "".join(chr(k) + " a" for k in range(0x300) if k),
         " " * 1_000_000, "a" + "\n" * 1_000_000, "\t" * 5000 + "x", "é" + " \n" * 4000 + "1", "中" + "　" * 5000 + "文", "a\x1c" + " " * 5000 + "\x1cb", " " * 6000 + "a" + " " * 6000, "a" * 1_000_000]


def reference(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_vocabulary())
    for x in texts:
        ids = t.encode(x or "", add_special_tokens=False).ids
        back = t.decode(ids, skip_special_tokens=False)
        yield len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()


def random_texts(n):
    rng = random.Random(3)
    parts = ["the ", "and", " tion", "'s", "'re", "  ", "\n", ".", ",", "123 ", "%%%", "é", "<|endoftext|>", "<|endof", "erth ", "ation "]
    shared = "".join(rng.choices(parts, k=4000))
    return ["".join(rng.choices(parts, k=rng.randint(1, 3000))) + (shared if k % 2 else "") for k in range(n)]


def test_same_as_tokenizers(spark):
    texts = TEXTS + random_texts(30)
    docs = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)], "doc_id long, text string, n_tokens string")
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode_documents(docs, bpe.default_vocabulary()).collect()}
    assert got == dict(enumerate(reference(texts)))


def test_chunks_are_reused():
    with open(bpe.default_vocabulary(), encoding="utf-8") as f:
        codec = bpe.Codec(f.read())
    rng = random.Random(5)
    words = [("".join(rng.choices("abcdefgh", k=rng.randint(1, 9)))) for _ in range(3000)]
    passage = " ".join(words).encode()
    data = np.frombuffer(b"Once upon a time " + passage + b" other words before " + passage, np.uint8)
    assert len(list(codec.texts(data, np.array([0, 17 + len(passage), len(data)])))) == 2
    assert codec.reused > 10


def test_every_latin_character_alike():
    with open(bpe.default_vocabulary(), encoding="utf-8") as f:
        codec = bpe.Codec(f.read())
    for k in range(1, 0x300):
        for t in (f"a{chr(k)}b", f"1 {chr(k)} b", f" {chr(k)}{chr(k)}"):
            assert codec.fast.encode(t, allowed_special="all") == codec.full.encode(t, add_special_tokens=False).ids, hex(k)


def test_empty_table(spark):
    assert bpe.encode_documents(spark.createDataFrame([], "doc_id long, text string"), bpe.default_vocabulary()).count() == 0


@pytest.mark.parametrize("extra", ["ids", "other"])
def test_texts_keep_their_columns(spark, extra):
    docs = spark.createDataFrame([(1, "the end", 5)], f"doc_id long, text string, {extra} int")
    row = bpe.encode_texts(docs, bpe.default_vocabulary()).first()
    with open(bpe.default_vocabulary(), encoding="utf-8") as f:
        assert bpe.Codec(f.read()).decode(row[-1]) == "the end"


def test_reuse_is_reported(spark):
    passage = " ".join(f"word{k * k}" for k in range(3000))
    docs = spark.createDataFrame([(k, passage) for k in range(6)], "doc_id long, text string").coalesce(1)
    counted = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    assert bpe.encode_documents(docs, bpe.default_vocabulary(), counted).count() == 6
    bpe.encode_documents(docs, bpe.default_vocabulary(), counted).collect()
    assert counted[1].value > counted[0].value / 4 > 0
