"""Secret scans: fixed patterns, and sliding-window Shannon entropy over candidate strings.

Everything is DataFrame expressions. Candidates are runs of at least 20 characters of the base-64
alphabet that hold a digit. A window of 20 characters slides over a candidate; counts per
character change by the one that enters and the one that leaves, and with them the sum of
c * log2(c), hence each window's entropy. The class of a candidate (hexadecimal, one case with
digits, mixed case with digits) sets the entropy that its best window needs. An allow list
suppresses what is known to look random and is no secret.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .spans import away_from, bound, marks, redacted, with_spans

#: Base patterns. Fixed values.
ASSIGN = r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ASSIGN_HEAD = r"""(?i)^(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
ACCESS = r"AKIA[A-Z0-9]++"
HEX = r"(?<![0-9a-f])[0-9a-f]{16,}+"
CANDIDATE = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{20,}+={0,2}"
WINDOW = 20
#: Bits that the best window of a candidate needs, by class.
BITS = {"hex": 2.8, "one_case": 3.5, "mixed": 3.7}
#: A short word or number, or one beside the other (``covid19``, ``1080p``). What mixes letters and digits in any other way goes to the entropy test.
PART = "^(?:[a-z]{0,11}|[A-Z]{0,11}|[A-Z][a-z]{1,10}|[0-9]{0,11}|(?:[a-z]{1,8}|[A-Z]{1,8}|[A-Z][a-z]{1,7})[0-9]{1,4}|[0-9]{1,4}(?:[a-z]{1,3}|[A-Z]{1,3}))$"
#: Allow list: digits alone, UUIDs, alphabets and counting, integrity hashes. Paths and names of short parts follow in :func:`allowed`.
ALLOWED = [
    r"^[0-9/_+-]++$",
    r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    r"(?i)abcdefgh|01234567|12345678|qwertyui",
    r"^sha(?:1|256|384|512)-",
]
KINDS, EXTRA = ("assign", "access", "hex"), "entropy"


def allowed(core: Column) -> Column:
    """Whether a candidate (without its padding) is on the allow list; parts are tested one by one, in no expression that recurses."""
    listed = F.lit(False)
    for rule in ALLOWED:
        listed = listed | core.rlike(rule)
    parts = F.split(core, "[/_+-]")
    return listed | (core.rlike("[/_+-]") & F.forall(parts, lambda p: p.rlike(PART)))


def best_entropy(s: Column) -> Column:
    """The largest Shannon entropy (bits per character) of any window of 20 characters, by incremental counts.

    ``s`` is ASCII, of 20 characters at least. A step changes two counts, of the character that
    leaves and of the one that enters, and with them the sum of c * log2(c) over the window.
    """
    weight = F.array(*(F.lit(c * math.log2(c) if c else 0.0) for c in range(WINDOW + 1)))
    count = lambda w, c: F.length(w) - F.length(F.replace(w, c, F.lit("")))
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"))

    def steps(raw: Column, weight: Column) -> Column:
        piece = lambda at, n: F.substring(raw, at + 1, n).cast("string")  # noqa: E731  bytes: no walk along the text

        def step(acc: Column, i: Column) -> Column:
            full = i >= WINDOW
            gone = F.when(full, piece(i - WINDOW, 1)).otherwise("")
            left = count(piece(F.greatest(i - WINDOW, F.lit(0)), F.least(i, F.lit(WINDOW))), gone)
            into = count(piece(F.greatest(i - WINDOW + 1, F.lit(0)), F.least(i, F.lit(WINDOW - 1))), piece(i, 1))
            total = acc["sum"] + F.get(weight, into + 1) - F.get(weight, into) + F.when(full, F.get(weight, left - 1) - F.get(weight, left)).otherwise(0.0)

            def kept(total: Column) -> Column:
                bits = F.lit(math.log2(WINDOW)) - total / WINDOW
                return F.struct(total.alias("sum"), F.when((i >= WINDOW - 1) & (bits > acc.best), bits).otherwise(acc.best).alias("best"))

            return bound(total, kept)

        return F.aggregate(F.sequence(F.lit(0), F.length(raw) - 1), start, step, lambda acc: acc.best)

    return bound(weight, lambda w: bound(s.cast("binary"), lambda raw: steps(raw, w)))


def with_secrets(df: DataFrame, text: str = "text", prefix: str = "__secret") -> DataFrame:
    """``df`` with columns ``{prefix}_assign``, ``_access``, ``_hex`` and ``_entropy`` of spans.

    A null or empty text has no spans. Base spans follow the fixed patterns alone; entropy spans
    are added where they overlap none of them.
    """
    t = F.col(text)
    some = t.contains("=") | t.contains(":")
    df = with_spans(df, f"{prefix}_assign", text, ASSIGN, some & t.rlike(r"(?i)passw|secret|token|api_?key"))
    value = lambda x: F.length(F.regexp_replace(x.m, ASSIGN_HEAD, ""))
    df = df.withColumn(f"{prefix}_assign", F.filter(f"{prefix}_assign", lambda x: value(x) >= 12))
    df = with_spans(df, f"{prefix}_access", text, ACCESS, t.contains("AKIA"))
    df = df.withColumn(f"{prefix}_access", F.filter(f"{prefix}_access", lambda x: F.length(x.m) >= 18))
    df = with_spans(df, f"{prefix}_hex", text, HEX, t.rlike("[0-9a-f]{16}"))
    df = with_spans(df, f"{prefix}_entropy", text, CANDIDATE, t.rlike("[0-9]") & t.rlike("[A-Za-z0-9+/_-]{20}"))
    base = [f"{prefix}_{k}" for k in KINDS]
    df = df.withColumn(f"{prefix}_entropy", away_from(F.col(f"{prefix}_entropy"), base))

    def secret(x: Column) -> Column:
        def judged(core: Column) -> Column:
            need = F.when(core.rlike("^(?:[0-9a-f]++|[0-9A-F]++)$"), BITS["hex"]).when(core.rlike("[a-z]") & core.rlike("[A-Z]"), BITS["mixed"]).otherwise(BITS["one_case"])
            return F.when(allowed(core), False).otherwise(best_entropy(core) >= need)

        return bound(F.regexp_replace(x.m, "=+$", ""), judged)

    return df.withColumn(f"{prefix}_entropy", F.when(F.size(f"{prefix}_entropy") > 0, F.filter(f"{prefix}_entropy", secret)).otherwise(F.col(f"{prefix}_entropy")))


def redact_secrets(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every found span of ``text`` replaced by ``mask``; all rows and other columns stay.

    ``n_chars`` follows the new text where the table has it; null texts stay null.
    """
    columns = [f"__secret_{k}" for k in (*KINDS, EXTRA)]
    out = with_secrets(docs).withColumn("text", redacted("text", columns, mask))
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        changed = F.size(F.concat(*(F.col(c) for c in columns))) > 0
        out = out.withColumn("n_chars", F.when(changed, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))


def scan_secrets(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, counts of base spans, their digest, and all spans.

    A null or empty text has no spans (the digest is that of no bytes), repeated rows give repeated
    results, an empty table none; other columns are not read.
    """
    df = with_secrets(docs.select("doc_id", "text"))
    base = [f"__secret_{k}" for k in KINDS]
    df = df.select(
        "doc_id", *(F.size(f"__secret_{k}").cast("long").alias(f"n_{k}") for k in KINDS),
        marks(KINDS, base).alias("base"), marks([*KINDS, EXTRA], [*base, "__secret_entropy"]).alias("spans"),
    )
    return df.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")


def op9_entropy_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text of ``documents``; see :func:`scan_secrets`."""
    return scan_secrets(table(spark, sf_dir, "documents"))
