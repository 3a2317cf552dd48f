"""Removal of repeated passages: every byte under a 50-byte string that an earlier document has too.

Sorting all suffixes of a corpus at once is out of reach, so suffix arrays are built over shards
of text that can hold a repeat, and only of those:

1. Every 50-byte window is named by an anchor: of its 16-byte substrings the one with the least
   hash. Equal windows have equal anchors. Consecutive windows with one anchor form a run (35
   windows at most); a run's bytes are its context. Per block of texts, all runs but those of the
   least doc_id with the same anchor and context are settled at once, so a passage in a third of
   all documents sends one row per block and not one per document.
2. Runs meet by anchor, sorted, and pass by as a stream. Equal contexts settle each other. Where
   contexts differ, two runs share a 50-byte window only if 17 bytes on one side of the anchor are
   equal; runs for which that holds are sent on with their bytes.
3. Shards of such contexts, whole anchors together, get a suffix array by induced sorting and its
   permuted common prefixes; runs of suffixes that share 50 bytes give each window its least doc_id.
4. All windows found meet their document, whose bytes under them go.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_slices, table, written
from .shingles import mix
from .suffixes import permuted_prefixes, suffix_array

LENGTH, GRAM = 50, 16
SIDE = (LENGTH - GRAM) // 2
SLICE, BLOCK, SHARD = 2 << 20, 24 << 20, 1 << 20
LOW22, U = np.uint64((1 << 22) - 1), np.uint64
_VALUE = np.random.Generator(np.random.PCG64(77)).integers(1, 1 << 63, 256, np.uint64) * U(2) + U(1)
_FACTOR = 0x9E3779B97F4A7C15
_INVERSE = pow(_FACTOR, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def runs_of(data: np.ndarray, ends: np.ndarray):
    """Runs of windows with one anchor over a buffer of texts (less than 4 MB each, or alone).

    Returns arrays: text index, first window (from the text's start), windows, anchor hash,
    context hash, and hashes of the 17 bytes before and after the anchor.
    """
    n, sizes = len(data), np.diff(ends)
    if n < LENGTH or sizes.max() < LENGTH:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64, np.uint64, np.uint64))
    padded = np.concatenate([data, np.zeros(GRAM + 8, np.uint8)])
    words = np.ndarray((n + GRAM,), "<u8", padded.tobytes(), strides=(1,)).copy()
    grams = mix(words[: n + 8] * U(0xD1B54A32D192ED03) ^ mix(words[8 : n + 16])[: n + 8])[:n]
    # Least (hash, position) of the 35 grams of each window, by doubling.
    wide = n >= 1 << 22  # one very long text: positions need more bits than are set aside
    bits = U(22) if not wide else U(int(n).bit_length())
    low = (U(1) << bits) - U(1)
    least = (grams & ~low) | np.arange(n, dtype=np.uint64)
    span, m = 1, least
    while span * 2 <= LENGTH - GRAM + 1:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    rest = LENGTH - GRAM + 1 - span
    m = np.minimum(m[:-rest], m[rest:]) if rest else m
    # Windows that lie inside one text.
    valid = np.zeros(n + 1, np.int32)
    has = sizes >= LENGTH
    np.add.at(valid, ends[:-1][has], 1)
    np.add.at(valid, ends[1:][has] - LENGTH + 1, -1)
    window = np.flatnonzero(np.cumsum(valid)[: len(m)])
    spot = (m[window] & low).astype(np.int64)
    text = np.searchsorted(ends, window, side="right") - 1
    first = np.flatnonzero((np.diff(spot, prepend=-1) != 0) | (np.diff(text, prepend=-1) != 0))
    count = np.diff(np.append(first, len(window)))
    start, spot, text = window[first], spot[first], text[first]
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUE[data] * _powers(_FACTOR, n), out=sums[1:])
    back = _powers(_INVERSE, n)
    piece = lambda a, b: mix((sums[b] - sums[a]) * back[np.minimum(a, n - 1)])
    context = piece(start, start + count + LENGTH - 1)
    context = mix(context ^ (spot - start).astype(np.uint64) * U(131) ^ count.astype(np.uint64))
    a, b = spot - SIDE, spot + GRAM + SIDE
    unlike = mix(spot.astype(np.uint64) + U(12345))  # beyond a text's end nothing can be equal
    left = np.where(a >= ends[text], piece(np.maximum(a, 0), spot), unlike)
    right = np.where(b <= ends[text + 1], piece(spot + GRAM, np.minimum(b, n)), ~unlike)
    return text, start - ends[text], count, grams[spot], context, left, right


#: ``h`` holds 48 bits of the anchor's hash and 16 of its right side's; ``x`` 40 bits of the context's
#: hash and 24 of the left side's; ``y`` the first window (31 bits, as texts have at most), the number of windows (6), 23 bits
#: of the text's hash (rows that share a doc_id are told apart by them) and 4 more of the right side's.
OWN, LEFT = (1 << 23) - 1, (1 << 24) - 1


def pack(first, count, own, gram, context, left, right):
    h = (gram >> U(16)) << U(16) | right >> U(48)
    x = (context >> U(24)) << U(24) | left >> U(40)
    y = first.astype(np.uint64) << U(33) | count.astype(np.uint64) << U(27) | own.astype(np.uint64) << U(4) | (right >> U(44)) & U(15)
    return h.view(np.int64), x.view(np.int64), y.view(np.int64)


def unpack_y(y: np.ndarray):
    """First window, number of windows, and the text's hash."""
    v = y.view(np.uint64)
    return (v >> U(33)).astype(np.int64), ((v >> U(27)) & U(63)).astype(np.int64), ((v >> U(4)) & U(OWN)).astype(np.int64)


def own_of(y: str):
    """The text's hash in a packed column."""
    return F.shiftrightunsigned(y, 4).bitwiseAND(F.lit(OWN))


def intervals(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint ascending intervals of windows, from any intervals."""
    if not len(first):
        return first, count
    order = np.argsort(first, kind="stable")
    a, b = first[order], (first + count)[order]
    top = np.maximum.accumulate(b)
    new = np.append(True, a[1:] > top[:-1])
    at = np.flatnonzero(new)
    return a[at], np.append(top[at[1:] - 1], top[-1]) - a[at]


def by_document(doc: np.ndarray, own: np.ndarray, first: np.ndarray, count: np.ndarray):
    """(doc, own, flat list of first and count of its merged intervals) of each document."""
    if not len(doc):
        return
    order = np.lexsort((first, own, doc))
    doc, own, first, count = doc[order], own[order], first[order], count[order]
    cut = np.flatnonzero((np.diff(doc) != 0) | (np.diff(own) != 0)) + 1
    for a, b in zip(np.append(0, cut).tolist(), np.append(cut, len(doc)).tolist(), strict=True):
        f, c = intervals(first[a:b], count[a:b])
        yield int(doc[a]), int(own[a]), np.stack([f, c], axis=1).reshape(-1)


FOUND = "kind int, h long, x long, doc_id long, y long, spans binary"
OPEN, RUN, SPANS, ASK = range(4)  # a run to be settled; one to be removed; merged intervals to be removed; a run that may share more


def _batch(kind: int, h, x, doc, y, spans=None) -> pa.RecordBatch:
    n = len(doc)
    column = lambda v: pa.array(np.zeros(n, np.int64) if v is None else v, pa.int64())
    spans = pa.nulls(n, pa.binary()) if spans is None else pa.array(spans, pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), column(h), column(x), column(doc), column(y), spans], names=["kind", "h", "x", "doc_id", "y", "spans"])


def _settled(doc, own, first, count) -> pa.RecordBatch | None:
    rows = list(by_document(doc, own, first, count))
    if not rows:
        return None
    d, r, spans = zip(*rows, strict=True)
    d, r = np.array(d, np.int64), np.array(r, np.int64)
    return _batch(SPANS, mix(d.view(np.uint64) ^ r.view(np.uint64)).view(np.int64), None, d, r << 4, [v.astype("<i8").tobytes() for v in spans])


def local_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 1: rows of runs still open (spans null), and of spans settled within a block of texts."""
    held, size = [], 0

    def flush() -> Iterator[pa.RecordBatch]:
        doc, own, first, count, h, c, left, right = (np.concatenate(v) for v in zip(*held, strict=True))
        if not len(doc):
            return
        key = mix(h ^ mix(c))
        order = np.argsort(key, kind="stable")
        starts = np.flatnonzero(np.append(True, (np.diff(key[order]) != 0) | (np.diff(h[order]) != 0) | (np.diff(c[order]) != 0)))
        least = np.minimum.reduceat(doc[order], starts)
        later = np.empty(len(doc), bool)
        later[order] = doc[order] > np.repeat(least, np.diff(np.append(starts, len(order))))
        if (done := _settled(doc[later], own[later], first[later], count[later])) is not None:
            yield done
        keep = ~later
        doc = doc[keep]
        h, x, y = pack(*(v[keep] for v in (first, count, own, h, c, left, right)))
        for a in range(0, len(h), 100_000):
            yield _batch(OPEN, h[a : a + 100_000], x[a : a + 100_000], doc[a : a + 100_000], y[a : a + 100_000])

    for batch in batches:
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
        owns = batch.column("own").to_numpy(zero_copy_only=False)
        for first, end, data, ends in byte_slices(batch.column("text"), SLICE):
            text, at, count, h, c, left, right = runs_of(data, ends)
            held.append((ids[first:end][text], owns[first:end][text], at, count, h, c, left, right))
            size += len(data)
            if size >= BLOCK:
                yield from flush()
                held, size = [], 0
    if held:
        yield from flush()


def _several(group: np.ndarray, inner: np.ndarray) -> np.ndarray:
    """For each row, whether its group holds at least two different values of ``inner``; any order of rows."""
    order = np.lexsort((inner, group))
    g, v = group[order], inner[order]
    starts = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
    lengths = np.diff(np.append(starts, len(g)))
    out = np.empty(len(g), bool)
    out[order] = np.repeat(v[starts] != v[starts + lengths - 1], lengths)
    return out


def settle_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 2, over rows sorted by anchor: what can be removed, and requests for runs that may share more.

    Memory: the different contexts of one anchor, about 100 bytes each.
    """

    def groups(h, x, doc, y) -> Iterator[pa.RecordBatch]:
        # A context is known by its own 40 bits and the 24 of its left side, among those of one anchor.
        gram, context, left = h >> np.int64(16), x, x & np.int64(LEFT)
        right = (h & np.int64(0xFFFF)) << np.int64(4) | y & np.int64(15)
        key = mix(gram.view(np.uint64) ^ mix(context.view(np.uint64)))
        order = np.argsort(key, kind="stable")
        starts = np.flatnonzero(np.append(True, (np.diff(key[order]) != 0) | (np.diff(gram[order]) != 0) | (np.diff(context[order]) != 0)))
        least = np.minimum.reduceat(doc[order], starts)
        low = np.empty(len(doc), np.int64)
        low[order] = np.repeat(least, np.diff(np.append(starts, len(order))))
        later = doc > low
        if later.any():
            yield _batch(RUN, None, None, doc[later], y[later])
        live = ~later & _several(gram, context)
        gram, context, left, right, doc, y = (v[live] for v in (gram, context, left, right, doc, y))
        if len(gram):
            g = gram.view(np.uint64)
            ask = _several(mix(g) + left.view(np.uint64), context) | _several(~mix(g) + right.view(np.uint64), context)
            ask &= _several(gram, doc)
            if ask.any():
                yield _batch(ASK, gram[ask], None, doc[ask], y[ask])

    held: list[list[np.ndarray]] = []  # the last anchor so far: it may go on, through many batches
    for batch in batches:
        still = batch.column("kind").to_numpy() == OPEN
        if not still.all():
            yield batch.filter(pa.array(~still))
            batch = batch.filter(pa.array(still))
        part = [batch.column(k).to_numpy(zero_copy_only=False) for k in ("h", "x", "doc_id", "y")]
        if not len(part[0]):
            continue
        gram = part[0] >> np.int64(16)
        if held and gram[0] != held[0][0][0] >> np.int64(16):
            yield from groups(*(np.concatenate(v) for v in zip(*held, strict=True)))
            held = []
        last = int(np.searchsorted(gram, gram[-1]))
        if last:
            yield from groups(*(np.concatenate([*(h[k] for h in held), v[:last]]) for k, v in enumerate(part)))
            held = []
        held.append([v[last:] for v in part])
    if held:
        yield from groups(*(np.concatenate(v) for v in zip(*held, strict=True)))


def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the runs that step 2 asks for, from the documents' texts."""
    for batch in batches:
        for text, doc, asked in zip(batch.column("text"), batch.column("doc_id"), batch.column("asked"), strict=True):
            raw = text.as_py()
            rows = asked.as_py()
            first, count, _ = unpack_y(np.array([r["y"] for r in rows], np.int64))
            for a in range(0, len(rows), 5000):
                part = slice(a, a + 5000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["h"] for r in rows[part]], pa.int64()), pa.array([doc.as_py()] * len(rows[part]), pa.int64()), pa.array([r["y"] for r in rows[part]], pa.int64()), pa.array([raw[f : f + c + LENGTH - 1] for f, c in zip(first[part].tolist(), count[part].tolist(), strict=True)], pa.binary())],
                    names=["h", "doc_id", "y", "bytes"],
                )


def shared_windows(data: np.ndarray, ends: np.ndarray, doc: np.ndarray, length: int = LENGTH):
    """(piece, first window, windows) of the windows in pieces of a buffer that a piece of a smaller doc has too."""
    order = suffix_array(data, length)
    shared = permuted_prefixes(data, order, length)
    piece = np.searchsorted(ends, np.arange(len(data)), side="right") - 1
    inside = np.arange(len(data)) + length <= ends[1:][piece]
    group = np.flatnonzero(np.append(True, shared[order[1:]] < length))
    top = np.iinfo(np.int64).max
    value = np.where(inside, doc[piece], top)
    least = np.empty(len(data), np.int64)
    least[order] = np.repeat(np.minimum.reduceat(value[order], group), np.diff(np.append(group, len(data))))
    hit = np.flatnonzero(inside & (least < value))
    if not len(hit):
        return hit, hit, hit
    at = np.flatnonzero((np.diff(hit, prepend=-2) != 1) | (np.diff(piece[hit], prepend=-1) != 0))
    count = np.diff(np.append(at, len(hit)))
    return piece[hit[at]], hit[at] - ends[piece[hit[at]]], count


def shard_suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 3, over rows sorted by anchor: spans that suffix arrays of shards find."""
    held, size, last = [], 0, None

    def flush() -> pa.RecordBatch | None:
        raw = [r[2] for r in held]
        ends = np.concatenate([[0], np.cumsum([len(b) for b in raw])])
        doc = np.array([r[0] for r in held], np.int64)
        piece, at, count = shared_windows(np.frombuffer(b"".join(raw), np.uint8), ends, doc)
        first, _, own = unpack_y(np.array([r[1] for r in held], np.int64))
        return _settled(doc[piece], own[piece], first[piece] + at, count)

    for batch in batches:
        for h, d, y, b in zip(*(batch.column(k).to_pylist() for k in ("h", "doc_id", "y", "bytes")), strict=True):
            if h != last and size >= SHARD:
                if (found := flush()) is not None:
                    yield found
                held, size = [], 0
            held.append((d, y, b))
            size += len(b)
            last = h
    if held and (found := flush()) is not None:
        yield found


def removals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 4: what goes from each document, given packed runs and merged intervals of windows."""
    for batch in batches:
        if not batch.num_rows:
            continue
        out: list[list] = [[], [], [], []]
        for text, runs, spans in zip(batch.column("text"), batch.column("runs"), batch.column("spans"), strict=True):
            raw = text.as_py() or b""
            first, count, _ = unpack_y(runs.values.to_numpy(zero_copy_only=False) if runs.is_valid and len(runs) else np.empty(0, np.int64))
            flat = np.frombuffer(b"".join(spans.as_py() or []), "<i8").reshape(-1, 2)
            first, count = intervals(np.concatenate([first, flat[:, 0]]), np.concatenate([count, flat[:, 1]]) + LENGTH - 1)
            kept, at, removed = hashlib.sha256(), 0, 0
            for a, c in zip(first.tolist(), count.tolist(), strict=True):
                kept.update(raw[at:a])
                at, removed = a + c, removed + c
            kept.update(raw[at:])
            for column, v in zip(out, (len(raw), removed, len(first), kept.hexdigest()), strict=True):
                column.append(v)
        yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(v, pa.int64()) for v in out[:3]), pa.array(out[3], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def keyed_texts(docs: DataFrame) -> DataFrame:
    """id, doc_id (null ones last), own, text as bytes."""
    return docs.select(
        F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("doc_id"), F.xxhash64("text").bitwiseAND(F.lit(OWN)).alias("own"), F.col("text").cast("binary").alias("text")
    )


def repeated_spans(docs: DataFrame) -> DataFrame:
    """Rows of kind RUN and SPANS: what can be removed from which document."""
    keyed = keyed_texts(docs).where(F.length("text") >= LENGTH).select("doc_id", "own", "text")
    gram = F.shiftright("h", 16)
    found = written(keyed.mapInArrow(local_runs, FOUND).repartition(gram).sortWithinPartitions("h").mapInArrow(settle_anchors, FOUND), "anchors")
    asks = found.where(F.col("kind") == ASK).select("doc_id", own_of("y").alias("own"), F.struct("h", "y").alias("ask"))
    asks = asks.groupBy("doc_id", "own").agg(F.collect_list("ask").alias("asked"))
    pieces = keyed.join(asks, ["doc_id", "own"]).select("doc_id", "text", "asked").mapInArrow(contexts, "h long, doc_id long, y long, bytes binary")
    more = pieces.repartition("h").sortWithinPartitions("h").mapInArrow(shard_suffixes, FOUND)
    return found.where(F.col("kind").isin(RUN, SPANS)).unionByName(more)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of ``docs``.

    Null texts count as empty; texts under 50 bytes lose nothing. Rows that share a doc_id are not
    earlier than each other; null doc_ids come after all others. Repeated rows get equal results.
    """
    runs = repeated_spans(docs).groupBy("doc_id", own_of("y").alias("own")).agg(F.collect_list(F.when(F.col("kind") == RUN, F.col("y"))).alias("runs"), F.collect_list("spans").alias("spans"))
    both = keyed_texts(docs).join(runs, ["doc_id", "own"], "left")
    none = F.array().cast
    both = both.select("id", "text", F.coalesce("runs", none("array<bigint>")).alias("runs"), F.coalesce("spans", none("array<binary>")).alias("spans"))
    return both.mapInArrow(removals, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of each whole text of ``documents`` an earlier one has too; see :func:`remove_repeats`."""
    return remove_repeats(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents),
place AS (SELECT doc_id, b, unnest(range(0, n - 49)) AS i FROM d WHERE n >= 50),
w AS (SELECT doc_id, i, b[i + 1 : i + 50] AS g FROM place),
first AS (SELECT g, min(doc_id) AS least FROM w GROUP BY g),
hit AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS new FROM w JOIN first USING (g) WHERE least < doc_id),
run AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS r FROM hit),
span AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS e FROM run GROUP BY doc_id, r),
piece AS (SELECT doc_id, lag(e, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS s, a AS t FROM span UNION ALL SELECT doc_id, coalesce(max(e), 0), any_value(n) FROM d LEFT JOIN span USING (doc_id) GROUP BY doc_id),
kept AS (SELECT doc_id, sha256(unhex(coalesce(string_agg(CASE WHEN t > s THEN hex(b[s + 1 : t]) ELSE '' END, '' ORDER BY s), ''))) AS kept_sha256 FROM piece JOIN d USING (doc_id) GROUP BY doc_id),
gone AS (SELECT doc_id, sum(e - a)::BIGINT AS n_removed, count(*)::BIGINT AS n_spans FROM span GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, kept_sha256 FROM d JOIN kept USING (doc_id) LEFT JOIN gone USING (doc_id)
"""
