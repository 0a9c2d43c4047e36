"""Offset-bearing text extraction in built-in functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def phrase_pattern(terms: list[str]) -> str:
    """Terms as one pattern: longest first, no word character at either side, any case."""
    body = "|".join(re.escape(t) for t in sorted(dict.fromkeys(terms), key=len, reverse=True))
    return rf"(?iU)(?<!\w)(?:{body})(?!\w)"


def target_pattern(term: Column) -> Column:
    """The pattern of one term that each row brings, taken literally; null for none or a blank one."""
    t = F.trim(term)
    quoted = F.concat(F.lit(r"(?iU)(?<!\w)\Q"), F.replace(t, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(?!\w)"))
    return F.when(t != "", quoted)


def matches(text: Column, pattern: str | Column) -> Column:
    """array<struct<begin, end, match>> of all matches: what lies between them and they themselves, summed up."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    ends = _running(F.zip_with(gaps, F.transform(found, F.length), lambda g, n: g + F.coalesce(n, F.lit(0))))
    made = F.zip_with(ends, found, lambda e, m: F.struct((e - F.length(m)).alias("begin"), e.alias("end"), m.alias("match")))
    return F.filter(made, lambda x: x["match"].isNotNull())


#: Arrays built by appending are built in pieces of this size: appending to one long array copies it each time.
_PIECE = 256


def _let(value: Column, f) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _sums_from(steps: Column, start: Column) -> Column:
    one = F.struct(start.cast("int").alias("at"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(steps, one, lambda a, x: F.struct((a["at"] + x).alias("at"), F.array_append(a["out"], a["at"] + x).alias("out")), lambda a: a["out"])


def _running(steps: Column) -> Column:
    """Running sums of an array of lengths: sums of pieces first, then each piece from the sum in front of it."""

    def by_pieces(s: Column) -> Column:
        last = F.greatest(F.ceil(F.size(s) / _PIECE).cast("int") - 1, F.lit(0))
        pieces = F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(s, i * _PIECE + 1, _PIECE))
        return _let(pieces, lambda p: F.flatten(F.zip_with(p, F.slice(starts(p), 1, F.size(p)), _sums_from)))

    def starts(p: Column) -> Column:
        whole = F.transform(p, lambda x: F.aggregate(x, F.lit(0), lambda a, y: a + y))
        return F.concat(F.array(F.lit(0)), _sums_from(whole, F.lit(0)))

    return _let(steps, by_pieces)


def sentences(text: Column) -> Column:
    """array<struct<begin, end>>: cut after end marks with white space behind, and after line ends."""
    cut = r"(?U)(?<=[.!?])\s+|\n+"
    gaps = F.transform(F.split(text, cut, -1), F.length)
    seps = F.concat(F.transform(F.regexp_extract_all(text, F.lit(cut), 0), F.length), F.array(F.lit(0)))
    lengths = F.zip_with(gaps, seps, lambda g, n: g + n)
    cuts = _let(lengths, lambda n: F.zip_with(_running(n), n, lambda e, x: F.struct((e - x).alias("begin"), e.alias("end"))))
    kept = F.filter(cuts, lambda s: s["end"] > s["begin"])
    return F.when(F.size(kept) == 0, F.array(F.struct(F.lit(0).alias("begin"), F.length(text).alias("end")))).otherwise(kept)


def leftmost_longest(found: Column) -> Column:
    """Matches that do not overlap: by start, longer first, then pattern order."""
    ordered = F.array_sort(F.transform(found, lambda m: F.struct(m["begin"].alias("begin"), (-m["end"]).alias("neg_end"), m["ord"].alias("ord"), m["category"].alias("category"), m["match"].alias("match"))))
    empty = F.array().cast("array<struct<begin:int,neg_end:int,ord:int,category:string,match:string>>")
    return F.aggregate(ordered, empty, lambda acc, m: F.when((F.size(acc) == 0) | (m["begin"] >= -F.element_at(acc, -1)["neg_end"]), F.array_append(acc, m)).otherwise(acc))


def span_text(text: Column, cuts: Column, begin: Column, end: Column) -> Column:
    """The sentence that holds a position, else 220 characters to either side, with white space collapsed."""
    s = F.try_element_at(F.filter(cuts, lambda x: (x["begin"] <= begin) & (begin < x["end"])), F.lit(1))
    low = F.greatest(begin - 220, F.lit(0))
    piece = F.coalesce(F.substring(text, s["begin"] + 1, s["end"] - s["begin"]), F.substring(text, low + 1, end - low + 220))
    return F.regexp_replace(F.regexp_replace(piece, r"(?U)\s+", " "), "^ | $", "")
