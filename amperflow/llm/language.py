"""Language identification by a bidirectional gated recurrent network over bytes.

The network is trained in numpy on the driver by backpropagation through time, on a bounded
sample of labelled documents. Each direction has its own gated recurrent cell; every byte position
gets a distribution over the learned languages from both states; a document's probabilities are
the mean over all its positions. Whole texts are read in windows of 64 bytes, all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_slices, table

UNITS, STEPS, BATCH, WIDTH = 8, 300, 192, 64
#: Bounds of the training sample: documents per language, windows of each.
SAMPLE_DOCS, SAMPLE_WINDOWS = 400, 16
#: Languages up to which the steps are enough; with more of them steps grow, and batches of windows shrink, in proportion.
LANGUAGES = 64
UNKNOWN = "und"


def sigmoid(x: np.ndarray, out: np.ndarray) -> np.ndarray:
    """In place, by the hyperbolic tangent, which numpy has as one fast loop."""
    np.multiply(x, 0.5, out=out)
    np.tanh(out, out=out)
    out *= 0.5
    out += 0.5
    return out


class Network:
    """Parameters per direction: input rows ``w`` (256 x 3h), recurrent ``u`` (h x 3h); output ``v`` (2h x k), ``c``."""

    def __init__(self, languages: list[str], units: int = UNITS, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.languages, self.h = languages, units
        f = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.p = {"v": f(2 * units, len(languages), scale=0.3), "c": np.zeros(len(languages), np.float32)}
        for d in "fb":
            self.p |= {f"w{d}": f(256, 3 * units, scale=0.3), f"u{d}": f(units, 3 * units, scale=0.3)}

    def states(self, x: np.ndarray, d: str, keep: bool = False):
        """States (time x batch x h) of one direction over byte windows ``x`` (time x batch)."""
        w, u, h = self.p[f"w{d}"], self.p[f"u{d}"], self.h
        n, b = x.shape
        out = np.empty((n, b, h), np.float32)
        s, a, g = np.zeros((b, h), np.float32), np.empty((b, 3 * h), np.float32), np.empty((b, 2 * h), np.float32)
        cand, r = np.empty((b, h), np.float32), np.empty((b, h), np.float32)
        kept = []
        u_gates, u_cand = np.ascontiguousarray(u[:, : 2 * h]), np.ascontiguousarray(u[:, 2 * h :])
        for t in range(n) if d == "f" else range(n - 1, -1, -1):
            np.take(w, x[t], axis=0, out=a, mode="clip")
            np.matmul(s, u_gates, out=g)
            g += a[:, : 2 * h]
            sigmoid(g, g)  # update gate, reset gate
            np.multiply(g[:, h:], s, out=r)
            np.matmul(r, u_cand, out=cand)
            cand += a[:, 2 * h :]
            np.tanh(cand, out=cand)
            if keep:
                kept.append((t, s.copy(), g.copy(), r.copy(), cand.copy()))
            # s + z * (cand - s)
            np.subtract(cand, s, out=cand)
            cand *= g[:, :h]
            s = np.add(s, cand, out=out[t])
        return (out, kept) if keep else out

    def positions(self, x: np.ndarray) -> np.ndarray:
        """Probabilities (time x batch x languages) of every position."""
        z = self.states(x, "f") @ self.p["v"][: self.h]
        z += self.states(x, "b") @ self.p["v"][self.h :]
        z += self.p["c"]
        z -= z.max(axis=2, keepdims=True)
        np.exp(z, out=z)
        z /= z.sum(axis=2, keepdims=True)
        return z

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy over all positions, and its gradients by backpropagation through time."""
        h, (n, b) = self.h, x.shape
        runs = {d: self.states(x, d, keep=True) for d in "fb"}
        both = np.concatenate([runs["f"][0], runs["b"][0]], axis=2)
        z = both @ self.p["v"] + self.p["c"]
        z -= z.max(axis=2, keepdims=True)
        e = np.exp(z)
        p = e / e.sum(axis=2, keepdims=True)
        loss = -np.log(p[:, np.arange(b), y] + 1e-9).mean()
        p[:, np.arange(b), y] -= 1
        p /= n * b
        flat = both.reshape(-1, 2 * h)
        grad = {"v": flat.T @ p.reshape(-1, p.shape[2]), "c": p.sum(axis=(0, 1))}
        dboth = p @ self.p["v"].T
        for k, d in enumerate("fb"):
            u = self.p[f"u{d}"]
            da_all = np.empty((n, b, 3 * h), np.float32)
            du = np.zeros_like(u)
            ds = np.zeros((b, h), np.float32)
            for t, s, g, r, cand in reversed(runs[d][1]):
                ds = ds + dboth[t][:, k * h : (k + 1) * h]
                zg, rg = g[:, :h], g[:, h:]
                dc = ds * zg * (1 - cand * cand)
                dr = dc @ u[:, 2 * h :].T
                dz = ds * (cand - s) * zg * (1 - zg)
                dg = np.concatenate([dz, dr * s * rg * (1 - rg)], axis=1)
                du[:, 2 * h :] += r.T @ dc
                du[:, : 2 * h] += s.T @ dg
                da_all[t, :, : 2 * h], da_all[t, :, 2 * h :] = dg, dc
                ds = ds * (1 - zg) + dr * rg + dg @ u[:, : 2 * h].T
            dw = np.zeros_like(self.p[f"w{d}"])
            order = np.argsort(x, axis=None, kind="stable")
            sorted_x, rows = x.reshape(-1)[order], da_all.reshape(-1, 3 * h)[order]
            first = np.flatnonzero(np.diff(sorted_x, prepend=-1))
            dw[sorted_x[first]] = np.add.reduceat(rows, first, axis=0)
            grad |= {f"w{d}": dw, f"u{d}": du}
        return float(loss), grad

    def train(self, windows: np.ndarray, y: np.ndarray, steps: int = STEPS, batch: int = BATCH, seed: int = 5) -> list[float]:
        """Adam steps on random batches of windows (rows), equally many of each language."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        of = [np.flatnonzero(y == k) for k in range(len(self.languages))]
        losses = []
        for step in range(1, steps + 1):
            lang = rng.integers(0, len(of), batch)
            pick = np.array([of[k][rng.integers(0, len(of[k]))] for k in lang])
            loss, grad = self.gradients(np.ascontiguousarray(windows[pick].T).astype(np.int64), y[pick])
            losses.append(loss)
            rate = 0.02 * min(1.0, 2.0 * (1 - step / (steps + 1)))
            norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            for k, g in grad.items():
                g = g * np.float32(min(1.0, 1.0 / (norm + 1e-9)))
                m[k] = 0.9 * m[k] + 0.1 * g
                s[k] = 0.99 * s[k] + 0.01 * g * g
                self.p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        return losses

    def documents(self, data: np.ndarray, ends: np.ndarray, rows: int = 1024) -> np.ndarray:
        """Mean probabilities over all byte positions of each text in a buffer (uniform for empty ones)."""
        n, k = len(ends) - 1, len(self.languages)
        rows = max(1, rows * LANGUAGES // max(k, LANGUAGES))
        sizes = np.diff(ends)
        count = -(-sizes // WIDTH)
        doc = np.repeat(np.arange(n), count)
        index = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
        start = ends[:-1][doc] + index * WIDTH
        length = np.minimum(ends[1:][doc] - start, WIDTH)
        total = np.zeros((n, k))
        padded = np.concatenate([data, np.zeros(WIDTH, np.uint8)])
        steps = np.arange(WIDTH)
        for a in range(0, len(doc), rows):
            x = padded[start[a : a + rows] + steps[:, None]]
            mask = steps[:, None] < length[a : a + rows]
            x[~mask] = 0
            p = self.positions(x)
            p *= mask[:, :, None]
            np.add.at(total, doc[a : a + rows], p.sum(axis=0, dtype=np.float64))
        return np.where(sizes[:, None] > 0, total / np.maximum(sizes, 1)[:, None], 1 / max(k, 1))


def labelled_windows(docs: DataFrame, languages: list[str], counts: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Byte windows and labels of a bounded sample: the ``SAMPLE_DOCS`` documents a language with the least hashes, and ``SAMPLE_WINDOWS`` windows from places all over each, set by hash.

    The sample depends on the rows alone, not on how they lie. Hashes above a bound that half as many
    documents again reach are left out before anything is shuffled.
    """
    shares = docs.sparkSession.createDataFrame([(lang, min(1.0, (1.5 * SAMPLE_DOCS + 50) / counts[lang])) for lang in languages], "lang string, __share double")
    h = F.xxhash64("doc_id", "text")
    taken = docs.withColumn("__h", h).join(F.broadcast(shares), "lang").where(F.pmod("__h", F.lit(1_000_003)) / 1_000_003.0 < F.col("__share"))
    room = F.greatest(F.length("text") - WIDTH, F.lit(0)) + 1
    windows = F.transform(F.sequence(F.lit(0), F.lit(SAMPLE_WINDOWS - 1)), lambda k: F.col("text").substr(F.pmod(F.xxhash64(F.col("__h"), k), room).cast("int") + 1, F.lit(WIDTH)))
    order = Window.partitionBy("lang").orderBy(F.pmod("__h", F.lit(1_000_003)), "__h", "doc_id")
    rows = taken.select("lang", "doc_id", "__h", windows.alias("parts")).withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= SAMPLE_DOCS).select("lang", "parts").collect()
    found, labels, place = [], [], {lang: k for k, lang in enumerate(languages)}
    for lang, parts in sorted((r.lang, r.parts) for r in rows):
        for part in parts:
            w = np.frombuffer(part.encode(), np.uint8)[:WIDTH]
            found.append(np.pad(w, (0, WIDTH - len(w))))
            labels.append(place[lang])
    return np.array(found, np.uint8).reshape(-1, WIDTH), np.array(labels, np.int64)


def held_out() -> Column:
    """Whether crc32 of the doc_id as text leaves 0 modulo 5; null where the doc_id is null."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def train_on(docs: DataFrame) -> Network:
    """A network trained on rows that have text with letters, a lang, and are not held out."""
    usable = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out())
    counts = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}
    languages = sorted(counts)
    net = Network(languages)
    if len(languages) > 1:
        windows, y = labelled_windows(usable, languages, counts)
        present = sorted(set(y.tolist()))
        if len(present) < len(languages):  # a language whose few documents the sample missed
            net = Network([languages[k] for k in present])
            y = np.searchsorted(present, y)
        if len(present) > 1:
            net.train(windows, y, STEPS * max(1, -(-len(present) // LANGUAGES)))
    return net


def predict(docs: DataFrame, net: Network) -> DataFrame:
    """``docs`` with columns ``lang_pred`` and ``score``; every row stays.

    Null texts and texts without a letter get ``und`` and score 0, as does all where nothing was
    learned. Of equally likely languages the first by name is taken. Columns of these names that ``docs`` has already are replaced.
    """
    docs = docs.drop("lang_pred", "score")
    out = T.StructType([*docs.schema.fields, T.StructField("__ok", T.BooleanType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    names = np.array([*net.languages, UNKNOWN], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, ends in byte_slices(batch.column("text"), 1 << 20):
                part = batch.slice(first, end - first)
                ok = part.column("__ok").to_numpy(zero_copy_only=False).astype(bool)
                p = net.documents(data, ends) if net.languages else np.zeros((len(ok), 1))
                best = p.argmax(axis=1)
                score = np.clip(p[np.arange(len(p)), best], 0, 1) * ok
                lang = names[np.where(ok & bool(net.languages), best, len(net.languages))]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=out.names)

    marked = docs.withColumn("__ok", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    return marked.mapInArrow(run, out).drop("__ok")


def keep_identified(docs: DataFrame, min_score: float = 0.0) -> DataFrame:
    """The rows of ``docs`` whose text has a letter, and a language of at least ``min_score``; same columns.

    Rejected are null texts, texts without a letter, and less certain ones if a bound is set. Rows
    without a ``lang`` get the one that was found. Where no language could be learned, the text alone
    decides, and no row gets one.
    """
    net = train_on(docs)
    kept = predict(docs.withColumnRenamed("lang_pred", "__lang_pred").withColumnRenamed("score", "__score"), net)
    certain = F.col("score") >= min_score if net.languages else F.lit(True)
    kept = kept.where(F.col("text").rlike(r"\p{L}") & certain)
    if net.languages:
        kept = kept.withColumn("lang", F.coalesce("lang", "lang_pred"))
    kept = kept.drop("lang_pred", "score")
    return kept.withColumnRenamed("__lang_pred", "lang_pred").withColumnRenamed("__score", "score").select(*(F.col(f"`{c}`") for c in docs.columns))


def op7_recurrent_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text of ``documents``, learned from those that are not held out; see :func:`predict`."""
    docs = table(spark, sf_dir, "documents")
    found = predict(docs.select("doc_id", "text"), train_on(docs))
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")
