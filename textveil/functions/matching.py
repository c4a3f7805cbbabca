"""Regular expression matches with code-point offsets, as array columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int,text:string>>"
#: Marks places in a text while it is taken apart; does not occur in texts (it is removed first).
MARK = "\u0001"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once: inside a lambda, a plain expression is computed for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def spans(text: Column, pattern: str) -> Column:
    """All matches, left to right, as structs of start, end (half-open) and text.

    Offsets are running sums of the lengths of what stands between matches and of the matches.
    """
    none = F.array().cast(SPAN)

    def build(m: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            one = F.get(m["found"], i)
            start = acc["at"] + F.char_length(F.get(m["gaps"], i))
            end = start + F.char_length(one)
            return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), one.alias("text")))).alias("out"))

        folded = F.aggregate(F.sequence(F.lit(0), F.size(m["found"]) - 1), F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])
        return F.when(F.size(m["found"]) > 0, folded).otherwise(none)

    return let(F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("gaps")), build)


def checked_spans(text: Column, pattern: str, check: Callable[[Column], Column]) -> Column:
    """Matches of ``pattern`` between word bounds that ``check`` accepts, shortened until it does.

    Candidates start wherever the pattern fits, overlapping ones too.  A candidate is shortened
    at its blanks and hyphens, from the end, to its longest accepted prefix; then candidates are
    taken from left to right, each from the end of the one before.
    """
    clean = F.translate(text, MARK, " ")
    starts = F.split(F.regexp_replace(clean, rf"(?U)\b(?={pattern})", MARK), MARK, -1)
    surfaces = F.regexp_extract_all(clean, F.lit(rf"(?U)(?=\b({pattern}))"), F.lit(1))

    def longest(surface: Column) -> Column:
        n = F.char_length(surface)
        ends = F.filter(F.sequence(F.lit(1), n), lambda k: ((k == n) | F.substring(surface, k + 1, F.lit(1)).isin(" ", "-")) & check(F.substring(surface, F.lit(1), k)))
        return F.array_max(ends)

    none = F.array().cast(SPAN)

    def build(m: Column) -> Column:
        # Each candidate's shortened length is found once, before the fold.
        sizes = F.transform(m["surfaces"], longest)

        def step(acc: Column, x: Column) -> Column:
            at = acc["at"] + F.char_length(x["gap"])
            last = F.when(F.size(acc["out"]) > 0, F.get(acc["out"], F.size(acc["out"]) - 1)["end"]).otherwise(F.lit(0))
            one = F.array(F.struct(at.alias("start"), (at + x["size"]).alias("end"), F.substring(x["surface"], F.lit(1), x["size"]).alias("text")))
            return F.struct(at.alias("at"), F.when(x["size"].isNotNull() & (at >= last), F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

        n = F.size(m["surfaces"])
        items = F.arrays_zip(F.slice(m["starts"], F.lit(1), n).alias("gap"), m["surfaces"].alias("surface"), sizes.alias("size"))
        folded = F.aggregate(items, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])
        return F.when(n > 0, folded).otherwise(none)

    return let(F.struct(starts.alias("starts"), surfaces.alias("surfaces")), build)


def quoted(literal: Column) -> Column:
    """A literal as a pattern that matches just it."""
    return F.concat(F.lit("\\Q"), F.regexp_replace(literal, r"\\E", r"\\\\E\\\\\\\\E\\\\Q"), F.lit("\\E"))


def replaced(text: Column, pieces: Column) -> Column:
    """``text`` with the spans of ``pieces`` (sorted structs of start, end, new) replaced, from gaps and new parts in turn."""
    n = F.size(pieces)
    before = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(pieces, i - 1)["end"])
    gap = lambda i: F.substring(text, before(i) + 1, F.when(i == n, F.char_length(text)).otherwise(F.get(pieces, i)["start"]) - before(i))
    parts = F.transform(F.sequence(F.lit(0), n), lambda i: F.concat(gap(i), F.when(i < n, F.get(pieces, i)["new"]).otherwise(F.lit(""))))
    return F.when(n > 0, F.array_join(parts, "")).otherwise(text)
