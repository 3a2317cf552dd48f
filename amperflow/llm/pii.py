"""Personal data: high-recall candidate spans, scored by gradient-boosted trees on format and context.

Base spans follow fixed patterns and checks alone. Beyond them, generators propose overlapping
candidates (groups of digits with separators, spelled-out or spaced mail addresses, coded numbers).
Boosted trees, grown in numpy on the driver from generated examples of national formats with words
near them in four languages, become CASE expressions over features that Spark computes; Platt scaling
turns their sum into a probability, and a threshold chosen on held-out examples selects what is
added, the likeliest first, then whatever overlaps none chosen. Executors run DataFrame expressions only.
"""

from __future__ import annotations

import functools
import random
import re
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .spans import SPAN, away_from, between, bound, digits_of, luhn, marks, redacted, running, text_blocks, with_spans

#: Base patterns, possessive where that changes no match. Fixed values.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
CARD = r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS, EXTRA = ("email", "ip", "card", "phone"), "scored"
#: Generators of further candidates. They propose too much on purpose; none repeats without a bound or gives back.
DIGIT_GROUPS = r"(?<![A-Za-z0-9])\(?[0-9](?:[().\x20/-]{0,2}[0-9]){6,24}+(?![A-Za-z0-9])"
#: One group of digits beside another one, which the generator before takes as one: both are proposed.
ONE_GROUP = r"(?:(?<=[0-9]\x20)\(?[0-9](?:[()./-]{0,2}[0-9]){6,17}+(?![A-Za-z0-9])|(?<![A-Za-z0-9])\(?[0-9](?:[()./-]{0,2}[0-9]){6,17}+(?=\x20\(?[0-9]))"
SPELLED_MAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?(?:\(at\)|\[at\]|@)\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z0-9-]++){1,8}+"
CODED = r"(?<![A-Za-z0-9])(?:[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}+(?:\x20?[A-Z0-9]{1,3})?|[A-Z]{2}\x20?[0-9]{2}\x20?[0-9]{2}\x20?[0-9]{2}\x20?[A-D]|[0-9]{8}-?[A-Z])(?![A-Za-z0-9])"
REACH = 40
#: Beginnings of words near a candidate that tell of telephones, identity, accounts, birth, mail, or of other numbers (English, German, French, Spanish). Fixed values.
NEAR = {
    "tel": "phone|tel|call|mobile|cell|fax|contact|reach|ring|whatsapp|handy|rufnummer|anruf|mobil|appel|portable|joindre|móvil|llam",
    "identity": "ssn|social|passport|tax|identity|national|insurance|ausweis|steuer|versicherung|sécurité|carte|dni|nif|pasaporte|seguridad",
    "account": "iban|account|bank|konto|compte|cuenta",
    "birth": "born|birth|dob|geboren|geburt|née?|naissance|nacid|nacimiento",
    "mail": "e?-?mail|write|schreib|écri|correo|escrib",
    "other": "version|order|invoice|isbn|issn|page|total|price|sku|serial|build|chapter|vol|copyright|ref|part|doi|score|licen|ticket|tracking|lot|model|table|section|line|bytes|release|bestell|rechnung|seite|preis|artikel|commande|facture|prix|pedido|factura|precio|página|versión",
}
NEAR_WORD = {k: rf"(?i)(?<![\p{{L}}])(?:{v})" for k, v in NEAR.items()}
FEATURES = ("digits", "length", "groups", "longest", "first", "second", "last", "pairs", "fours", "dots", "dashes", "spaces", "slashes", "parens", "letters", "zero", "year", "spelled", "luhn", *NEAR)
EXAMPLES, ROUNDS, DEPTH, RATE, PRECISION, BINS = 6000, 80, 4, 0.25, 0.99, 24


def features(m: str, before: str, after: str) -> list[float]:
    """Format and context features of one candidate, as :func:`feature_columns` computes them."""
    digits = re.sub("[^0-9]", "", m)
    groups = [g for g in re.split("[^0-9]+", m) if g]
    sizes = [len(g) for g in groups]
    total = sum(d if (len(digits) - k) % 2 else (d * 2 - 9 if d > 4 else d * 2) for k, d in enumerate(map(int, digits)))
    near = before + " " + after
    return [
        float(x) for x in (
            len(digits), len(m), len(groups), max(sizes, default=0), sizes[0] if sizes else 0, sizes[1] if len(sizes) > 1 else 0, sizes[-1] if sizes else 0, sum(k == 2 for k in sizes), sum(k == 4 for k in sizes),
            m.count("."), m.count("-"), m.count(" "), m.count("/"), m.count("(") + m.count(")"), len(re.sub("[^A-Za-z]", "", m)), digits.startswith("0"), any(re.fullmatch("(?:19|20)[0-9]{2}", g) is not None for g in groups),
            bool(re.search(r"@|[(\[]at[)\]]", m)), len(digits) > 11 and total % 10 == 0, *(bool(re.search(rf"(?i)(?<![^\W\d_])(?:{v})", near)) for v in NEAR.values()),
        )
    ]


def feature_columns(m: Column, before: Column, after: Column) -> list[Column]:
    digits, near = digits_of(m), F.concat_ws(" ", before, after)
    groups = F.filter(F.split(m, "[^0-9]+"), lambda g: F.length(g) > 0)
    count = lambda c: F.length(m) - F.length(F.replace(m, F.lit(c), F.lit("")))
    size = lambda g: F.coalesce(F.length(g), F.lit(0))
    parts = [
        F.length(digits), F.length(m), F.size(groups), F.coalesce(F.array_max(F.transform(groups, lambda g: F.length(g))), F.lit(0)), size(F.get(groups, 0)), size(F.get(groups, 1)), size(F.try_element_at(groups, F.lit(-1))),
        F.size(F.filter(groups, lambda g: F.length(g) == 2)), F.size(F.filter(groups, lambda g: F.length(g) == 4)), count("."), count("-"), count(" "), count("/"), count("(") + count(")"), F.length(F.regexp_replace(m, "[^A-Za-z]", "")),
        digits.startswith("0"), F.exists(groups, lambda g: g.rlike("^(?:19|20)[0-9]{2}$")), m.rlike(r"@|[(\[]at[)\]]"), (F.length(digits) > 11) & luhn(digits), *(near.rlike(v) for v in NEAR_WORD.values()),
    ]
    return [p.cast("double") for p in parts]


#: Formats of examples: ``d`` stands for a digit, ``n`` for one from 2 to 9, ``L`` for a capital, ``{}`` for a word. Those of a kind, and
#: whether they are personal data without a word near them that says so. Fixed values.
FORMATS = {
    "tel": (("(ndd) ddd-dddd", "ndd-ddd-dddd", "ndd.ddd.dddd", "1-ndd-ddd-dddd", "0d dd dd dd dd", "0d.dd.dd.dd.dd", "0d-dd-dd-dd-dd", "(0dd) ddd ddd dd", "07ddd dddddd", "020 dddd dddd"), True),
    "tel?": (("ndd ddd dddd", "dddddddddd", "0ddd-ddddddd", "0ddd ddddddd", "0dd/ddddddd", "030 dddddddd", "01ddd dddddd", "0ddd ddd dddd", "0ddddddddd", "07ddddddddd", "6dd dd dd dd", "9dd ddd ddd", "6dddddddd"), False),
    "identity": (("ndd-dd-dddd", "LL dd dd dd L", "dddddddd-L"), True),
    "identity?": (("ddddddddd", "nd ddd ddd ddd", "n dd dd dd ddd ddd dd", "ddddddddL", "LLddddddL"), False),
    "account": (("DEdd dddd dddd dddd dddd dd", "GBddLLLLdddddddddddddd", "FRdd dddd dddd dddd dddd dddd ddd", "ESdddddddddddddddddddddd"), True),
    "account?": (("dddddddddd", "ndd ddd dddd", "dddddddd"), False),
    "birth?": (("19dd-0n-1d", "1d.0n.19dd", "0n/1d/19dd", "1d/0n/20dd", "20dd-1d-2d"), False),
    "mail": (("{} (at) {} (dot) com", "{}.{} [at] {}.org", "{} @ {}.net", "{}(at){}.de"), True),
    "other": (("ddddddd", "dddd-dd-dd", "dd/dd/dddd", "d.dd.dddd", "978-d-dddd-dddd-d", "dddd dddd", "ddd ddd ddd", "dddddddddddd", "dddddddddddddddddddd", "ddddd.ddddd", "dddd-dddd", "d d d dd ddd", "dddd.dd.dd.ddd", "dd-dd-ddd-ddd", "20dd-0n-1d 1d", "dd dd dd dd", "dddddddd", "dddddddddd", "ddd.ddd.ddd.ddd.ddd", "n.ddd.ddd.ddd", "dddd dddd dddd dddd", "ddd-ddd-ddd-ddd", "LLdd dddd LLLL dddd", "LLdddddddddddddd"), False),
}
#: A word for each kind of context, in four languages; of those that tell of other numbers as well. Fixed values.
CUES = {
    "tel": ("phone", "call", "mobile", "reach me at", "contact", "fax", "Telefon", "Handy", "Rufnummer", "téléphone", "appelez", "portable", "teléfono", "móvil", "llame al"),
    "identity": ("ssn", "social security", "passport", "tax id", "national insurance", "Ausweis", "Steuernummer", "sécurité sociale", "DNI", "NIF"),
    "account": ("account", "iban", "bank", "Konto", "compte", "cuenta"),
    "birth": ("born", "date of birth", "dob", "geboren am", "née le", "né le", "nacido el"),
    "mail": ("mail", "write to", "email", "schreiben an", "écrire à", "correo"),
    "other": ("version", "order", "invoice", "isbn", "page", "total", "price", "serial", "build", "ref", "score", "ticket", "tracking", "lot", "Bestellung", "Rechnung", "Seite", "commande", "facture", "pedido", "precio"),
}


def examples(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of ``n`` generated candidates.

    A format of a sure kind is personal data unless a word near it tells of another number; one that
    other numbers share is, only where a word of its own kind is near.
    """
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghilmnoprstu", k=rng.randint(2, 9)))
    make = {"d": lambda: rng.choice("0123456789"), "n": lambda: rng.choice("23456789"), "L": lambda: rng.choice("ABCDEFGHJKLMNPQRSTWXYZ")}
    filler = lambda k: " ".join(word() for _ in range(rng.randint(0, k)))
    kinds, x, y = list(FORMATS), [], []
    of = {f: {k.rstrip("?") for k, (formats, _) in FORMATS.items() if f in formats} for formats, _ in FORMATS.values() for f in formats}
    for k in range(n):
        kind = "other" if k % 2 else rng.choice(kinds[:-1])
        formats, sure = FORMATS[kind]
        plain = kind.rstrip("?")
        pattern = rng.choice(formats)
        m = pattern.format(*(word() for _ in range(3))) if "{}" in pattern else "".join(make[c]() if c in make else c for c in pattern)
        about = rng.choices([plain, "other", "", rng.choice([c for c in CUES if c != plain])], [5, 2, 3, 1])[0]
        cue = rng.choice(CUES[about]) if about else ""
        before = f"{filler(3)} {cue}{rng.choice([': ', ' ', ' no. ', ' '])}" + (filler(1) + " " if rng.random() < 0.2 else "")
        x.append(features(m, before[-REACH:], f" {filler(4)}"[:REACH]))
        y.append(about != "other" and (about in of[pattern] or sure))
    return np.array(x, float), np.array(y, float)


def grow(x: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int, least: float = 1.0):
    """A regression tree as nested tuples (feature, threshold, left, right), with float leaves; ``x`` holds bins between ``edges``."""
    gt, ht = g[rows].sum(), h[rows].sum()
    best = (1e-6, None, None)
    for f in range(x.shape[1]) if depth else ():
        if not len(edges[f]):
            continue
        gl = np.cumsum(np.bincount(x[rows, f], g[rows], len(edges[f]) + 1))[:-1]
        hl = np.cumsum(np.bincount(x[rows, f], h[rows], len(edges[f]) + 1))[:-1]
        gain = np.where((hl >= least) & (ht - hl >= least), gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1), 0)
        k = int(gain.argmax())
        if gain[k] > best[0]:
            best = (float(gain[k]), f, k)
    if best[1] is None:
        return float(gt / (ht + 1))
    left = x[rows, best[1]] <= best[2]
    return best[1], float(edges[best[1]][best[2]]), grow(x, edges, g, h, rows[left], depth - 1, least), grow(x, edges, g, h, rows[~left], depth - 1, least)


def tree_value(tree, x) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree


@functools.cache
def model() -> tuple[list, tuple[float, float], float]:
    """(trees, Platt scaling, threshold): grown on 6,000 generated examples, scaled and set on 3,000 others."""
    x, y = examples(EXAMPLES, 1)
    edges = [(v[:-1] + v[1:]) / 2 if len(v) <= BINS else np.unique(np.quantile(v, np.linspace(0.02, 0.98, BINS))) for v in map(np.unique, x.T)]
    bins = np.stack([np.searchsorted(e, c) for e, c in zip(edges, x.T, strict=True)], axis=1)
    trees, score, every = [], np.zeros(len(y)), np.arange(len(y))
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-score))
        tree = grow(bins, edges, y - p, np.maximum(p * (1 - p), 1e-6), every, DEPTH)
        trees.append(tree)
        score += RATE * np.array([tree_value(tree, v) for v in x])
    held_x, held_y = examples(EXAMPLES // 2, 2)
    s = np.array([RATE * sum(tree_value(t, v) for t in trees) for v in held_x])
    a, b = 1.0, 0.0
    for _ in range(200):  # Newton steps of a logistic fit on the sums, slightly regularised
        p = 1 / (1 + np.exp(-(a * s + b)))
        w = p * (1 - p) + 1e-9
        grad = np.array([((held_y - p) * s).sum() - 0.01 * a, (held_y - p).sum() - 0.01 * b])
        hess = np.array([[(w * s * s).sum() + 0.01, (w * s).sum()], [(w * s).sum(), w.sum() + 0.01]])
        step = np.clip(np.linalg.solve(hess, grad), -0.5, 0.5)
        a, b = a + step[0], b + step[1]
    p = 1 / (1 + np.exp(-(a * s + b)))
    order = np.argsort(-p)
    precision = np.cumsum(held_y[order]) / np.arange(1, len(order) + 1)
    enough = np.flatnonzero(precision >= PRECISION)
    threshold = float(p[order][enough[-1]]) if len(enough) else 1.0
    return trees, (float(a), float(b)), threshold


def tree_column(tree, x: list[Column]) -> Column:
    if isinstance(tree, tuple):
        return F.when(x[tree[0]] <= tree[1], tree_column(tree[2], x)).otherwise(tree_column(tree[3], x))
    return F.lit(tree)


def with_personal(df: DataFrame, text: str = "text", prefix: str = "__pii") -> DataFrame:
    """``df`` with columns ``{prefix}_email``, ``_ip``, ``_card``, ``_phone`` and ``_scored`` of spans.

    A null or empty text has no spans; matches that fail their check are dropped and not retried.
    Scored spans are added where they lie in no base span, the likeliest first.
    """
    t = F.col(text)
    some = t.rlike("[0-9]")
    df = with_spans(df, f"{prefix}_email", text, EMAIL, t.contains("@"))
    df = with_spans(df, f"{prefix}_ip", text, IP, some & t.rlike(r"[0-9]\.[0-9]++\.[0-9]"))
    df = df.withColumn(f"{prefix}_ip", F.filter(f"{prefix}_ip", lambda x: F.regexp_replace(F.concat(F.lit("."), x.m), r"\.0+(?=[0-9])", ".").rlike(r"^(?:\.(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})){4}$")))
    df = with_spans(df, f"{prefix}_card", text, CARD, t.rlike(r"[0-9](?:[\x20-]?[0-9]){11}"))
    df = df.withColumn(f"{prefix}_card", F.filter(f"{prefix}_card", lambda x: F.length(digits_of(x.m)).between(12, 19) & luhn(F.substring(digits_of(x.m), 1, 20))))
    df = with_spans(df, f"{prefix}_phone", text, PHONE, t.rlike(r"\+[0-9]"))
    df = df.withColumn(f"{prefix}_phone", F.filter(f"{prefix}_phone", lambda x: F.length(digits_of(x.m)).between(9, 15)))
    base = [f"{prefix}_{k}" for k in KINDS]
    gates = {"c1": (DIGIT_GROUPS, t.rlike(r"[0-9](?:[().\x20/-]{0,2}[0-9]){6}")), "c4": (ONE_GROUP, t.rlike(r"[0-9](?:[()./-]{0,2}[0-9]){6}")), "c2": (SPELLED_MAIL, t.rlike(r"@|\(at\)|\[at\]")), "c3": (CODED, t.rlike("[A-Z]{2}\x20?[0-9]{2}|[0-9]{8}-?[A-Z]"))}
    for name, (pattern, gate) in gates.items():
        df = with_spans(df, f"{prefix}_{name}", text, pattern, gate)
    # Digits that all stand alone are a listing or a table and no number of anybody's.
    df = df.withColumn(f"{prefix}_c1", F.filter(f"{prefix}_c1", lambda x: x.m.rlike("[0-9][().-]?[0-9]")))
    # Groups of digits that touch a base span are its own; codes and addresses may reach beyond one.
    some = F.size(F.concat(*(F.col(f"{prefix}_{c}") for c in gates))) > 0
    wide = F.concat(F.col(f"{prefix}_c2"), F.col(f"{prefix}_c3"))
    none = F.array().cast(SPAN)
    df = df.withColumn(f"{prefix}_c", F.when(some, F.concat(away_from(F.concat(f"{prefix}_c1", f"{prefix}_c4"), base), not_within(wide, base))).otherwise(none))
    some = F.size(f"{prefix}_c") > 0
    blocks = F.when(some, text_blocks(t)).otherwise(F.array().cast("array<string>"))

    def scored(blocks: Column) -> Column:
        def one(x: Column) -> Column:
            parts = F.array(*feature_columns(x.m, between(blocks, x.s - REACH, x.s), between(blocks, x.e, x.e + REACH)))
            return bound(parts, lambda v: F.struct(x.s.alias("s"), x.e.alias("e"), x.m.alias("m"), probability(v).alias("p")))

        return F.transform(F.col(f"{prefix}_c"), one)

    threshold = model()[2]
    df = df.withColumn(f"{prefix}_p", F.when(some, bound(blocks, scored)))
    kept = F.filter(f"{prefix}_p", lambda x: x.p >= threshold)
    df = df.withColumn(f"{prefix}_scored", F.when(some, likeliest(kept)).otherwise(none))
    return df.drop(*(f"{prefix}_{c}" for c in (*gates, "c", "p")))


def probability(v: Column) -> Column:
    """The calibrated probability of an array of features, by the boosted trees."""
    trees, (a, b), _ = model()
    parts = [F.get(v, k) for k in range(len(FEATURES))]
    total = F.lit(0.0)
    for tree in trees:
        total = total + tree_column(tree, parts)
    return 1 / (1 + F.exp(-(total * (a * RATE) + b)))


def not_within(spans: Column, others: Sequence[str]) -> Column:
    """Those of ``spans`` that lie in no span of the columns ``others``."""
    tagged = lambda x, k: F.struct(x.s.alias("s"), F.lit(k).alias("k"), x.e.alias("e"), x.m.alias("m"))
    every = F.array_sort(F.concat(*(F.transform(F.col(o), lambda x: tagged(x, 0)) for o in others), F.transform(spans, lambda x: tagged(x, 1))))

    def outside(a: Column) -> Column:
        ends = running(F.transform(a, lambda x: F.when(x.k == 0, x.e).otherwise(0)), F.lit(0), lambda p, q: F.greatest(p, q))
        kept = F.filter(F.zip_with(a, ends, lambda x, e: F.struct(x.alias("x"), e.alias("e"))), lambda y: (y.x.k == 1) & (y.e < y.x.e))
        return F.transform(kept, lambda y: F.struct(y.x.s.alias("s"), y.x.e.alias("e"), y.x.m.alias("m")))

    return bound(every, outside)


def likeliest(spans: Column) -> Column:
    """Of spans (with p) the likeliest, then again the likeliest of those that overlap none chosen; of equally likely ones the first.

    Spans are cut into chains of overlapping ones, and chosen within each.
    """
    kind = "array<struct<n:double,s:int,e:int,m:string>>"

    def greedy(chain: Column) -> Column:
        order = F.array_sort(F.transform(chain, lambda x: F.struct((-x.p).alias("n"), x.s.alias("s"), x.e.alias("e"), x.m.alias("m"))))
        free = lambda acc, x: ~F.exists(acc, lambda y: (y.s < x.e) & (x.s < y.e))
        return F.aggregate(order, F.array().cast(kind), lambda acc, x: F.when(free(acc, x), F.concat(acc, F.array(x))).otherwise(acc))

    def chosen(a: Column) -> Column:
        def chains(reach: Column) -> Column:
            starts = F.filter(F.transform(a, lambda x, k: F.when((k == 0) | (x.s >= F.get(reach, k - 1)), k)), lambda k: k.isNotNull())
            return bound(starts, lambda t: F.transform(t, lambda k, j: F.slice(a, k + 1, F.coalesce(F.get(t, j + 1), F.size(a)) - k)))

        picked = lambda c: F.flatten(F.transform(c, lambda x: bound(x, greedy)))
        plain = lambda p: F.array_sort(F.transform(p, lambda x: F.struct(x.s.alias("s"), x.e.alias("e"), x.m.alias("m"))))
        return F.when(F.size(a) > 0, plain(picked(bound(bound(F.transform(a, lambda x: x.e), lambda e: running(e, F.lit(0), lambda p, q: F.greatest(p, q))), chains)))).otherwise(F.array().cast(SPAN))

    return bound(F.array_sort(spans), chosen)


def redact_personal(docs: DataFrame, mask: str = "[PII]") -> DataFrame:
    """``docs`` with every found span of ``text`` replaced by ``mask``; rows and other columns stay."""
    out = with_personal(docs).withColumn("text", redacted("text", [f"__pii_{k}" for k in (*KINDS, EXTRA)], mask))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))


def scan_personal(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, counts of base spans, their digest, and all spans.

    A null or empty text has no spans (the digest is that of no bytes), repeated rows give repeated
    results, an empty table none; other columns are not read.
    """
    df = with_personal(docs.select("doc_id", "text"))
    base = [f"__pii_{k}" for k in KINDS]
    df = df.select(
        "doc_id", *(F.size(f"__pii_{k}").cast("long").alias(f"n_{k}") for k in KINDS),
        marks(KINDS, base).alias("base"), marks([*KINDS, EXTRA], [*base, "__pii_scored"]).alias("spans"),
    )
    return df.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2("base", 256).alias("base_sha256"), "spans")


def op4_boosted_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text of ``documents``; see :func:`scan_personal`."""
    return scan_personal(table(spark, sf_dir, "documents"))
