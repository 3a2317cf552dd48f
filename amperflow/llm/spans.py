"""Spans of regular expressions as DataFrame expressions: no Python runs on the executors.

A span is struct<s int, e int, m string>: start and end in code points (end exclusive) and the
matched string. Matches are leftmost and do not overlap. The gaps between them come from splitting
the text at the same expression; starts are running sums of gaps and match lengths.

Costs are linear in the text and all but linear in the number of spans: arrays are scanned block by
block, spans are compared after sorting, and pieces of a text are cut from blocks of it. Patterns
given to these functions must not repeat a group unless possessively or a bounded number of times:
Java's expressions recurse for each repeat.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "array<struct<s:int,e:int,m:string>>"
BLOCK, CHARS = 256, 4096
LAST = (1 << 31) - 1


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` uses it and wherever the optimizer moves it."""
    return F.get(F.transform(F.array(value), f), 0)


def running(x: Column, zero: Column, op: Callable[[Column, Column], Column], kind: str = "int") -> Column:
    """``op`` (associative) over each prefix of an array, block by block; an empty array for an empty one."""
    none = F.array().cast(f"array<{kind}>")
    start = F.struct(zero.cast(kind).alias("s"), none.alias("a"))
    step = lambda acc, v: bound(op(acc.s, v).cast(kind), lambda s: F.struct(s.alias("s"), F.concat(acc.a, F.array(s)).alias("a")))

    def scanned(x: Column) -> Column:
        many = F.sequence(F.lit(0), F.floor((F.size(x) - 1) / BLOCK).cast("int"))
        blocks = F.transform(many, lambda b: F.aggregate(F.slice(x, b * BLOCK + 1, F.lit(BLOCK)), start, step))

        def joined(blocks: Column) -> Column:
            before = F.aggregate(blocks, start, lambda acc, b: F.struct(op(acc.s, b.s).cast(kind).alias("s"), F.concat(acc.a, F.array(acc.s)).alias("a")), lambda acc: acc.a)
            return F.flatten(F.zip_with(blocks, before, lambda b, s: F.transform(b.a, lambda v: op(s, v).cast(kind))))

        return F.when(F.size(x) > 0, bound(blocks, joined)).otherwise(none)

    return bound(x, scanned)


def with_spans(df: DataFrame, name: str, text: str, pattern: str, gate: Column) -> DataFrame:
    """``df`` with a column ``name`` of spans of ``pattern`` in column ``text``, empty where ``gate`` fails.

    A null text has none.
    """
    m = f"{name}__m"
    df = df.withColumn(m, F.when(gate, F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>")))

    def spans(m: Column) -> Column:
        gaps = F.transform(F.split(F.col(text), pattern, -1), lambda x: F.length(x))
        steps = bound(gaps, lambda g: F.transform(m, lambda x, k: F.get(g, k) + F.length(x)))
        ends = running(steps, F.lit(0), lambda a, b: a + b)
        return F.zip_with(m, ends, lambda x, e: F.struct((e - F.length(x)).alias("s"), e.alias("e"), x.alias("m")))

    return df.withColumn(name, F.when(F.size(m) > 0, bound(F.col(m), spans)).otherwise(F.array().cast(SPAN))).drop(m)


def away_from(spans: Column, others: Sequence[str]) -> Column:
    """Those of ``spans`` that overlap no span of the columns ``others``, by start.

    All are sorted by start; what reaches into a span is the furthest end before it or the next start after it.
    """
    tagged = lambda x, k: F.struct(x.s.alias("s"), F.lit(k).alias("k"), x.e.alias("e"), x.m.alias("m"))
    every = F.array_sort(F.concat(*(F.transform(F.col(o), lambda x: tagged(x, 0)) for o in others), F.transform(spans, lambda x: tagged(x, 1))))

    def clear(a: Column) -> Column:
        ends = running(F.transform(a, lambda x: F.when(x.k == 0, x.e).otherwise(0)), F.lit(0), lambda p, q: F.greatest(p, q))
        starts = F.reverse(running(F.reverse(F.transform(a, lambda x: F.when(x.k == 0, x.s).otherwise(LAST))), F.lit(LAST), lambda p, q: F.least(p, q)))
        both = F.zip_with(F.zip_with(a, ends, lambda x, e: F.struct(x.alias("x"), e.alias("before"))), starts, lambda y, s: F.struct(y.x.alias("x"), y.before.alias("before"), s.alias("after")))
        kept = F.filter(both, lambda y: (y.x.k == 1) & (y.before <= y.x.s) & (y.after >= y.x.e))
        return F.transform(kept, lambda y: F.struct(y.x.s.alias("s"), y.x.e.alias("e"), y.x.m.alias("m")))

    return bound(every, clear)


def marks(kinds: Sequence[str], columns: Sequence[str]) -> Column:
    """All spans as ``kind:start:end``, by start, then in the order of ``kinds``, joined by commas."""
    def tagged(column: str, rank: int, kind: str) -> Column:
        return F.transform(F.col(column), lambda x: F.struct(x.s.alias("s"), F.lit(rank).alias("r"), x.e.alias("e"), F.lit(kind).alias("k")))

    every = F.concat(*(tagged(c, r, k) for r, (k, c) in enumerate(zip(kinds, columns, strict=True))))
    return F.array_join(F.transform(F.array_sort(every), lambda x: F.concat_ws(":", x.k, x.s, x.e)), ",")


def digits_of(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)
    each = F.transform(F.split(digits, ""), lambda c: F.ascii(c) - 48)
    total = F.aggregate(
        F.transform(each, lambda d, k: F.when((n - k) % 2 == 1, d).when(d > 4, d * 2 - 9).otherwise(d * 2)), F.lit(0), lambda acc, d: acc + d
    )
    return (n > 0) & (total % 10 == 0)


def text_blocks(text: Column) -> Column:
    """A text in blocks of 4,096 code points, from which :func:`between` cuts."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHARS}}}"), F.lit(0))


def between(blocks: Column, start: Column, end: Column) -> Column:
    """Code points ``start`` to ``end`` (exclusive) of a text in blocks; what lies beyond its ends is left out."""
    start, end = F.greatest(start, F.lit(0)), F.least(end, F.size(blocks) * CHARS)
    part = lambda j: bound(F.greatest(start - j * CHARS, F.lit(0)), lambda a: F.get(blocks, j).substr(a + 1, F.least(end - j * CHARS, F.lit(CHARS)) - a))
    first, last = F.floor(start / CHARS).cast("int"), F.floor((end - 1) / CHARS).cast("int")
    return F.when(end > start, F.array_join(F.transform(F.sequence(first, F.greatest(first, last)), part), "")).otherwise("")


def redacted(text: str, columns: Sequence[str], mask: str) -> Column:
    """The text with every span of ``columns`` (overlapping ones merged) replaced by ``mask``.

    Spans are sorted by start; of spans that overlap, the union is replaced once.
    """
    every = F.array_sort(F.concat(*(F.transform(F.col(c), lambda x: F.struct(x.s.alias("s"), x.e.alias("e"))) for c in columns)))

    def replaced(a: Column) -> Column:
        reach = running(F.transform(a, lambda x: x.e), F.lit(0), lambda p, q: F.greatest(p, q))

        def joined(reach: Column) -> Column:
            cuts = F.zip_with(a, F.concat(F.array(F.lit(0)), F.slice(reach, 1, F.size(reach) - 1)), lambda x, b: F.struct(b.alias("b"), x.s.alias("s")))
            cuts = F.concat(F.filter(cuts, lambda c: c.s >= c.b), F.array(F.struct(F.element_at(reach, -1).alias("b"), F.lit(LAST).alias("s"))))
            return bound(text_blocks(F.col(text)), lambda blocks: F.array_join(F.transform(cuts, lambda c: between(blocks, c.b, c.s)), mask))

        return F.when(F.size(a) > 0, bound(reach, joined)).otherwise(F.col(text))

    return bound(every, replaced)
