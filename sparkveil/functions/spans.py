"""Span algebra over text columns, in Catalyst expressions only.

A span is a struct with ``start`` and ``end`` (half-open, in code points). ``find`` turns a regular
expression into spans, ``greedy`` keeps a non-overlapping subset in a given order, and ``render``
writes replacements into the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

HIT = "array<struct<start:int,end:int,value:string>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def unicode_regex(pattern: str) -> str:
    """Java reads \\w, \\d, \\s, \\b and case folding as ASCII unless told otherwise."""
    return "(?Uiu)" + pattern[4:] if pattern.startswith("(?i)") else "(?U)" + pattern


def found_in(text: Column, pattern: str) -> Column:
    return text.rlike(unicode_regex(pattern))


def find(text: Column, pattern: str, group: int = 0, prefilter: str | None = None) -> Column:
    """All matches, left to right without overlap, as structs start, end, value.

    The pieces between matches and the matches alternate, so their lengths give the positions. A
    ``group`` above 0 must end where the match ends; its span is returned. ``prefilter`` is a cheap
    expression that every text with a match satisfies.
    """
    p = unicode_regex(pattern)
    none = F.struct(F.lit(0).alias("at"), F.array().cast(HIT).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        first = acc["at"] + F.char_length(x["p"])
        if group:
            value = F.regexp_extract(x["m"], p, group)
        else:
            value = x["m"]
        end = first + F.char_length(x["m"])
        hit = F.struct((end - F.char_length(value)).cast("int").alias("start"), end.cast("int").alias("end"), value.alias("value"))
        return F.struct(end.cast("int").alias("at"), F.concat(acc["out"], F.array(hit)).alias("out"))

    def scan(t: Column) -> Column:
        pairs = let(F.regexp_extract_all(t, F.lit(p), F.lit(0)), lambda m: F.arrays_zip(m.alias("m"), F.slice(F.split(t, p, -1), F.lit(1), F.size(m)).alias("p")))
        spans = F.aggregate(pairs, none, step, lambda acc: acc["out"])
        return F.when(t.rlike(prefilter or p), spans).otherwise(F.array().cast(HIT))

    return let(text, scan)


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def ordered(spans: Column, key: Callable[[Column], list[Column]]) -> Column:
    """Spans sorted by the ascending ``key`` columns; ties keep the array's order."""
    keyed = F.transform(spans, lambda x, i: F.struct(*[k.alias(f"k{n}") for n, k in enumerate(key(x))], i.alias("i"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda y: y["x"])


def greedy(spans: Column, kind: str, key: Callable[[Column], list[Column]], clash: Callable[[Column, Column], Column] = overlaps) -> Column:
    """Walk the spans in the order of ``key`` and keep each that clashes with none kept before.
    ``kind`` is the array's type. The result is in that order, too."""
    none = F.array().cast(kind)
    return F.aggregate(ordered(spans, key), none, lambda acc, x: F.when(F.exists(acc, lambda c: clash(x, c)), acc).otherwise(F.concat(acc, F.array(x))))


def by_position(spans: Column) -> Column:
    return ordered(spans, lambda x: [x["start"], x["end"]])


def render(text: Column, spans: Column, replacement: Callable[[Column], Column]) -> Column:
    """The text with each of the non-overlapping spans, sorted by position, replaced."""
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        piece = F.substring(text, acc["at"] + 1, x["start"] - acc["at"])
        return F.struct(x["end"].alias("at"), F.concat(acc["out"], piece, replacement(x)).alias("out"))

    return F.aggregate(spans, begin, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.char_length(text))))
