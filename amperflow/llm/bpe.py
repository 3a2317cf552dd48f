"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the bytes cuts every text where its content says so, hence texts that share a
passage share its chunks; a chunk is encoded once per task and then taken from a cache of bounded
size. Around every cut the join is encoded again: it reaches back and forth to the nearest places
where the split into words cannot depend on what lies outside (a space between two visible ASCII
characters), and there both encodings agree, whatever the rest of the text holds.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.accumulators import Accumulator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import byte_slices, table

#: The split of byte-level BPE into words. Fixed value.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WINDOW, MASK_BITS, CACHE_MB, SLICE = 32, 9, 48, 4 << 20
#: Runs of white space (Unicode's property) from this length on are cut out before the split into words.
LONG = 4096
LONG_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % LONG)
#: First byte of U+0300. Beyond it, libraries' tables of letters and spaces may differ by version.
BEYOND_LATIN = 0xCC
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: itself if printable, else 256 upwards."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}


class Codec:
    """Encoder and decoder of one vocabulary file of the tokenizers library (byte-level BPE)."""

    def __init__(self, vocabulary: str):
        """``vocabulary``: the file's JSON text."""
        import tiktoken
        from tokenizers import Tokenizer

        spec, letters = json.loads(vocabulary), byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.table = {k: raw(t) for t, k in spec["model"]["vocab"].items() if t not in self.special}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        vocab = spec["model"]["vocab"]
        if any(vocab[a + b] != 256 + k for k, (a, b) in enumerate(merges)):
            raise ValueError("merges are not numbered in their order; this vocabulary needs another encoder")
        self.fast = tiktoken.Encoding("vocabulary", pat_str=WORDS, mergeable_ranks={v: k for k, v in self.table.items()}, special_tokens=self.special)
        self.full = Tokenizer.from_str(vocabulary)
        self.full.no_truncation()
        self.full.no_padding()
        self.table |= {k: t.encode() for t, k in self.special.items()}
        self.near: dict[bytes, tuple[bytes, bytes, int]] = {}
        self.far: dict[bytes, tuple[bytes, bytes, int]] = {}
        self.held = 0
        self.encoded = self.reused = 0

    def plain(self, piece: bytes, latin: bool) -> tuple[bytes, bytes, int]:
        """Ids as little-endian bytes, the decoded bytes, and the number of ids of a piece."""
        text, at, parts = piece.decode("utf-8", "replace"), 0, []
        ids = lambda s: self.fast.encode(s, allowed_special="all") if latin else self.full.encode(s, add_special_tokens=False).ids
        # A long run of white space is one word, but for its last character where more follows; the
        # split by a regular expression would try every shorter run first, and give up.
        for run in LONG_SPACE.finditer(text) if len(text) >= LONG else ():
            end = run.end() - (run.end() < len(text))
            parts += [ids(text[at : run.start()]), self.fast._encode_single_piece(text[run.start() : end])]
            at = end
        self.encoded += 1
        if not parts:
            only = ids(text)
            return np.array(only, "<u4").tobytes(), b"".join(map(self.table.__getitem__, only)), len(only)
        parts.append(ids(text[at:]))
        return b"".join(np.array(p, "<u4").tobytes() for p in parts), b"".join(b"".join(map(self.table.__getitem__, p)) for p in parts), sum(map(len, parts))

    def chunk(self, piece: bytes, latin: bool) -> tuple[bytes, bytes, int]:
        """As :meth:`plain`, but encoded only where neither half of the cache has it."""
        found = self.near.get(piece)
        if found is None:
            found = self.far.get(piece) or self.plain(piece, latin)
            self.near[piece] = found
            self.held += 2 * len(piece) + len(found[0]) + 300
            if self.held > CACHE_MB << 19:  # each half holds half of it
                self.near, self.far, self.held = {}, self.near, 0
        else:
            self.reused += 1
        return found

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.table.get(k, b"") for k in ids).decode("utf-8", "replace")

    def pieces(self, data: np.ndarray, cuts: np.ndarray, safe: np.ndarray) -> Iterator[tuple[bytes, bool]]:
        """(bytes, whether it is a chunk) of one text, in order. ``safe``: where words surely begin."""
        n = len(data)
        after = np.searchsorted(safe, cuts)  # the first safe place at or after each cut
        ahead = np.append(safe, n)[after].tolist()
        behind = np.insert(safe, 0, 0)[np.searchsorted(safe, cuts, side="right")].tolist()
        raw, at = data.tobytes(), 0
        for back, front in zip(behind, ahead, strict=True):
            if back > at:
                yield raw[at:back], True
                at = back
            if front > at:
                yield raw[at:front], False
                at = front
        if at < n:
            yield raw[at:], True

    def texts(self, data: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, str, str]]:
        """(n_tokens, ids_sha256, decoded_sha256) of each text in a buffer."""
        cuts, safe = content_cuts(data, ends), word_starts(data)
        beyond = np.flatnonzero(data >= BEYOND_LATIN)
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            if a == b:
                yield 0, EMPTY_SHA, EMPTY_SHA
                continue
            latin = np.searchsorted(beyond, a) == np.searchsorted(beyond, b)
            own = lambda x: x[np.searchsorted(x, a, side="right") : np.searchsorted(x, b)] - a  # noqa: E731, B023
            ids_sha, text_sha, n = hashlib.sha256(), hashlib.sha256(), 0
            for piece, whole in self.pieces(data[a:b], own(cuts), own(safe)):
                ids, decoded, m = (self.chunk if whole else self.plain)(piece, latin)
                ids_sha.update(ids)
                text_sha.update(decoded)
                n += m
            yield n, ids_sha.hexdigest(), text_sha.hexdigest()


def content_cuts(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Positions where the rolling hash of the last 32 bytes, all of one text, ends in zeros."""
    if len(data) < WINDOW:
        return np.empty(0, np.int64)
    gear = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 32, 256, np.uint32)
    h = gear[data]
    for k in (1, 2, 4, 8, 16):  # each pass doubles the window that h[i] covers
        h[k:] = h[k:] + (h[:-k] << np.uint32(k))
    found = np.flatnonzero(h >> np.uint32(32 - MASK_BITS) == 0) + 1
    begin = ends[np.searchsorted(ends, found, side="left") - 1]
    return found[found - begin >= WINDOW]


def word_starts(data: np.ndarray) -> np.ndarray:
    """Positions of a space between two visible ASCII characters: words end and begin there in any context."""
    visible = (data > 32) & (data < 127)
    return np.flatnonzero((data[1:-1] == 32) & visible[:-2] & visible[2:]) + 1


def encode_documents(docs: DataFrame, vocabulary_path: str, counted: tuple[Accumulator, Accumulator] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for every row, and the columns to ``keep``; a null text counts as empty.

    The vocabulary is read by the driver and sent along (its size is fixed). Rows are handled
    where they are read: nothing is shuffled, and a task's memory is bounded by the cache, a slice
    of 4 MB of texts, or the longest text. Repeated rows give repeated results; an empty table none.
    ``counted``: accumulators that get how many pieces were encoded, and how many came from a cache.
    """
    with open(vocabulary_path, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    out = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()), *(docs.schema[c] for c in keep)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = None
        for batch in batches:
            codec = codec or Codec(spec.value)
            for first, end, data, ends in byte_slices(batch.column("text"), SLICE):
                n, a, b = zip(*codec.texts(data, ends), strict=True)
                ids = batch.column("doc_id").slice(first, end - first).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string()), *(batch.column(c).slice(first, end - first) for c in keep)], names=out.names)
        if counted and codec:
            counted[0].add(codec.encoded)
            counted[1].add(codec.reused)

    return docs.select("doc_id", "text", *keep).mapInArrow(run, out)


def encode_texts(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """``docs`` with a column ``ids`` (array of int): for those who want the tokens themselves."""
    with open(vocabulary_path, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    name = "ids" if "ids" not in docs.columns else "token_ids"
    out = T.StructType([*docs.schema.fields, T.StructField(name, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = None
        for batch in batches:
            codec = codec or Codec(spec.value)
            for first, end, data, ends in byte_slices(batch.column("text"), SLICE):
                ids = []
                cuts, safe = content_cuts(data, ends), word_starts(data)
                for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                    own = lambda x: x[np.searchsorted(x, a, side="right") : np.searchsorted(x, b)] - a  # noqa: E731, B023
                    latin = not (data[a:b] >= BEYOND_LATIN).any()
                    ids.append(np.frombuffer(b"".join((codec.chunk if whole else codec.plain)(p, latin)[0] for p, whole in codec.pieces(data[a:b], own(cuts), own(safe))), "<i4") if b > a else np.empty(0, "<i4"))
                part = batch.slice(first, end - first)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ids, pa.list_(pa.int32()))], names=[*part.schema.names, name])

    return docs.mapInArrow(run, out)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op8_chunk_reuse_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text of ``documents`` under the 50k vocabulary; see :func:`encode_documents`."""
    return encode_documents(table(spark, sf_dir, "documents"), default_vocabulary())
