"""Spans of pattern matches, in code points, with Spark's own functions.

``split`` and ``regexp_extract_all`` walk a text alike (leftmost, not
overlapping), so the pieces between the matches and the matches themselves give
every position. Patterns must not match the empty string. They are written with
possessive quantifiers and a start guard, which keep the match of the plain
pattern but never walk a long run again from each of its characters.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<s:int,e:int,m:string,g:string,l:string>"
CONTEXT_CHARS = 80
#: Matches placed in one go.
PART = 256


def run_start(chars: str) -> str:
    """Guard: only where a run of ``chars`` begins, or the last match ended."""
    return rf"(?:\G|(?<![{chars}]))"


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """array<SPAN>: start, end (exclusive), match, a group of it, and up to
    CONTEXT_CHARS characters of text since the last match."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    between = F.split(text, pattern, -1)
    zipped = F.arrays_zip(whole.alias("m"), part.alias("g"), F.slice(between, F.lit(1), F.size(whole)).alias("p"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["p"])
        end = start + F.length(x["m"])
        left = F.substring(x["p"], -CONTEXT_CHARS, CONTEXT_CHARS)
        one = F.struct(start.alias("s"), end.alias("e"), x["m"].alias("m"), x["g"].alias("g"), left.alias("l"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    none = F.array().cast(f"array<{SPAN}>")
    placed = lambda part, at: F.aggregate(part, F.struct(at.alias("at"), none.alias("out")), step, lambda acc: acc["out"])
    # appending to an array copies it, so many matches are placed part by part
    parts = F.transform(F.sequence(F.lit(1), F.size(whole), F.lit(PART)), lambda i: F.slice(zipped, i, F.lit(PART)))
    length = lambda x: F.length(x["p"]) + F.length(x["m"])
    sizes = F.transform(parts, lambda part: F.aggregate(part, F.lit(0), lambda n, x: n + length(x)))
    starts = F.aggregate(sizes, F.array(F.lit(0)), lambda at, n: F.concat(at, F.array(F.element_at(at, -1) + n)))
    long = F.flatten(F.zip_with(parts, F.slice(starts, F.lit(1), F.size(sizes)), placed))
    return F.when(F.regexp_count(text, F.lit(pattern)) > PART, long).when(F.regexp_like(text, F.lit(pattern)), placed(zipped, F.lit(0))).otherwise(none)


def only_digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((2 * d.cast("int")) % 10 + F.floor(2 * d.cast("int") / 10)))
    return F.aggregate(each, F.lit(0).cast("long"), lambda total, x: total + x) % 10 == 0


def joined(spans: Column, kinds: Sequence[str]) -> Column:
    """kind:start:end of an array of struct<k:int,s:int,e:int,...>, comma-joined."""
    names = F.array(*map(F.lit, kinds))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")
