"""Matches of patterns with their places, as column expressions.

A text is marked in one pass of a pattern and cut at the marks, so pieces between matches and matches
take turns; running lengths of the pieces are the places. Spans of several patterns are concatenated, sorted, and
freed of those that others cover. All of it stays on the JVM, and no step goes through an array once for each element.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

SPAN = "struct<start:int,end:int,raw:string,groups:array<string>>"
#: Fixed value: everything that counts as white space, beyond ASCII too.
SPACE = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
#: Edges of words of ASCII letters, digits and underscores.
LEFT, RIGHT = "(?<![0-9A-Za-z_])", "(?![0-9A-Za-z_])"
MARK, INNER = "\x01", "\x02"
CHUNK = 256


def so_far(values: Column, op: Callable[[Column, Column], Column], start: int = 0) -> Column:
    """For each place of an array of integers, ``op`` over the values before it, from ``start`` on. Chunks are summed up first, so n values cost some n * (CHUNK + n / CHUNK**2)."""
    over = lambda part: F.aggregate(part, F.lit(start), op)

    def chunked(vs: Column) -> Column:
        last = F.ceil(F.size(vs) / CHUNK).cast("int") - 1
        whole = F.transform(F.sequence(F.lit(0), last), lambda c: over(F.slice(vs, c * CHUNK + 1, F.lit(CHUNK))))
        heads = let(whole, lambda cs: F.transform(cs, lambda _, c: over(F.slice(cs, F.lit(1), c))))
        own = lambda i: over(F.slice(vs, i - i % CHUNK + 1, i % CHUNK))
        return F.when(F.size(vs) > 0, let(heads, lambda hs: F.transform(vs, lambda _, i: op(F.get(hs, F.floor(i / CHUNK).cast("int")), own(i))))).otherwise(vs)

    return let(values, chunked)


def spans(text: Column, pattern: str, groups: int = 0) -> Column:
    """array<struct<start, end, raw, groups>> of all matches, in order; places are code points from 0, the end exclusive. A group that isn't met is empty.

    The two control characters that mark matches count as blanks. A null text has no matches."""
    clear = lambda t: F.when(F.contains(t, F.lit(MARK)) | F.contains(t, F.lit(INNER)), F.translate(t, MARK + INNER, "  ")).otherwise(t)
    marked = lambda t: F.regexp_replace(clear(t), pattern, MARK + INNER.join(["$0", *(f"${k}" for k in range(1, groups + 1))]) + MARK)
    none = F.array().cast(f"array<{SPAN}>")

    def placed(pieces: Column) -> Column:
        sizes = F.transform(pieces, lambda p: F.length(F.substring_index(p, INNER, 1)))

        def span(parts: Column, at: Column) -> Column:
            raw = F.get(parts, F.lit(0))
            return F.struct(at.alias("start"), (at + F.length(raw)).alias("end"), raw.alias("raw"), F.slice(parts, 2, max(1, groups)).alias("groups"))

        every = let(so_far(sizes, lambda a, b: a + b), lambda ats: F.transform(pieces, lambda p, i: F.when(i % 2 == 1, let(F.split(p, INNER, -1), lambda parts: span(parts, F.get(ats, i))))))
        return F.when(F.size(pieces) > 1, F.filter(every, lambda s: s.isNotNull())).otherwise(none)

    # Each ``let`` keeps an expression from being computed as often as it is named.
    return let(F.coalesce(text, F.lit("")), lambda t: let(F.split(marked(t), MARK, -1), placed))


def group(span: Column, k: int) -> Column:
    """Group k of a span, from 1 on; null where it isn't met."""
    return F.nullif(F.get(span["groups"], F.lit(k - 1)), F.lit(""))


def before(text: Column, span: Column, reach: int) -> Column:
    """Up to ``reach`` code points before a span."""
    return F.substring(text, F.greatest(span["start"] - reach, F.lit(0)) + 1, F.least(span["start"], F.lit(reach)))


def after(text: Column, span: Column, reach: int) -> Column:
    return F.substring(text, span["end"] + 1, F.lit(reach))


def apart(found: Column, rank: str) -> Column:
    """Spans that no other covers, in order. Of equal ones that of the least field ``rank`` stays, and a longer one wins over what it covers."""
    keyed = F.array_sort(F.transform(found, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s[rank].alias("rank"), s.alias("it"))))

    def swept(ks: Column) -> Column:
        reached = so_far(F.transform(ks, lambda k: -k["back"]), lambda a, b: F.greatest(a, b), -1)
        return let(reached, lambda to: F.transform(F.filter(F.zip_with(ks, to, lambda k, r: F.when(-k["back"] > r, k)), lambda k: k.isNotNull()), lambda k: k["it"]))

    return let(keyed, swept)
