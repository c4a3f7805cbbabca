"""Regions of Markdown text in which nothing is looked for, and the masked view of equal length."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .matching import let, spans

REGIONS = "array<struct<start:int,end:int,kind:string>>"
#: Patterns of the regions.
COMMENT = r"(?s)<!--.*?-->"
INLINE_CODE = r"(?s)(?<!`)(`+)(?!`)(.+?)(?<!`)\1(?!`)"
AUTOLINK = r"<([a-zA-Z][a-zA-Z0-9+.-]*:[^<>\s]+)>"
BARE_URL = r"(?U)(?<![\w@])(?:https?://|www\.)[^\s<>\)\]\"']+"
LINK_TARGET = r"(?<=\]\()\s{0,9}(?:<[^>]*>|[^\s\)]+)"
REFERENCE = r"(?m)^ {0,3}\[[^\]]+\]:\s*\S+"
FENCE_OPEN = r"^ {0,3}(`{3,}|~{3,})(.*)$"


def _as(found: Column, kind: str) -> Column:
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def fences(text: Column) -> Column:
    """Fenced code, line by line: opened by three or more backticks or tildes, closed by as many of
    the same with nothing after them, or else by the end of the text."""
    lines = F.split(text, "\n", -1)
    none = F.array().cast(REGIONS)
    start = F.struct(F.lit(0).alias("at"), F.lit(-1).alias("from"), F.lit("").alias("mark"), none.alias("out"))

    def step(acc: Column, line: Column) -> Column:
        bare = F.regexp_replace(line, "\r$", "")
        mark, rest = F.regexp_extract(bare, FENCE_OPEN, 1), F.regexp_extract(bare, FENCE_OPEN, 2)
        inside = acc["from"] >= 0
        opens = ~inside & (mark != "") & ~(mark.startswith("`") & rest.contains("`"))
        closes = inside & (mark != "") & (F.left(mark, F.lit(1)) == F.left(acc["mark"], F.lit(1))) & (F.char_length(mark) >= F.char_length(acc["mark"])) & (F.trim(rest) == "")
        end = acc["at"] + F.char_length(line) + 1
        region = F.array(F.struct(acc["from"].alias("start"), F.least(end, F.char_length(text)).alias("end"), F.lit("fenced-code").alias("kind")))
        return F.struct(
            end.alias("at"),
            F.when(opens, acc["at"]).when(closes, F.lit(-1)).otherwise(acc["from"]).alias("from"),
            F.when(opens, mark).when(closes, F.lit("")).otherwise(acc["mark"]).alias("mark"),
            F.when(closes, F.concat(acc["out"], region)).otherwise(acc["out"]).alias("out"),
        )

    def end(acc: Column) -> Column:
        rest = F.array(F.struct(acc["from"].alias("start"), F.char_length(text).alias("end"), F.lit("fenced-code").alias("kind")))
        return F.when(acc["from"] >= 0, F.concat(acc["out"], rest)).otherwise(acc["out"])

    return F.when(text.rlike("```|~~~"), F.aggregate(lines, start, step, end)).otherwise(none)


def coalesced(regions: Column) -> Column:
    """Sorted regions with those that touch or overlap made one; of two kinds, ``mixed``."""
    order = F.array_sort(F.transform(regions, lambda r: F.struct(r["start"].alias("start"), (-r["end"]).alias("back"), r["kind"].alias("kind"))))

    def step(acc: Column, r: Column) -> Column:
        end = -r["back"]
        last = F.get(acc, F.size(acc) - 1)
        one = F.struct(r["start"].alias("start"), end.alias("end"), r["kind"].alias("kind"))
        longer = end > last["end"]
        kind = F.when(longer & (last["kind"] != r["kind"]), F.lit("mixed")).otherwise(last["kind"])
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], end).alias("end"), kind.alias("kind"))
        joins = (F.size(acc) > 0) & (r["start"] <= last["end"])
        return F.when(joins, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(joined))).otherwise(F.concat(acc, F.array(one)))

    return F.aggregate(order, F.array().cast(REGIONS), step)


def protected_regions(text: Column) -> Column:
    """Fences and comments; inline code, links and URLs that don't touch those; ``mailto:`` is never protected."""
    none = F.array().cast(REGIONS)
    first = F.concat(fences(text), F.when(text.contains("<!--"), _as(spans(text, COMMENT), "html-comment")).otherwise(none))
    plain = lambda found: F.filter(found, lambda s: ~F.lower(s["text"]).contains("mailto:"))
    more = F.concat(
        F.when(text.contains("`"), _as(spans(text, INLINE_CODE), "inline-code")).otherwise(none),
        _as(plain(spans(text, AUTOLINK)), "autolink"), _as(spans(text, BARE_URL), "url"),
        _as(plain(spans(text, LINK_TARGET)), "link-target"),
        F.transform(plain(spans(text, REFERENCE)), lambda s: F.struct((s["end"] - F.char_length(F.regexp_extract(s["text"], r"(\S+)$", 1))).alias("start"), s["end"].alias("end"), F.lit("link-ref").alias("kind"))),
    )
    apart = lambda f: F.filter(more, lambda m: ~F.exists(f, lambda r: (m["start"] < r["end"]) & (r["start"] < m["end"])))
    return let(first, lambda f: coalesced(F.concat(f, apart(f))))


def masked(text: Column, regions: Column) -> Column:
    """The text with protected characters as blanks; line ends stay, so offsets hold."""
    n = F.size(regions)
    before = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(regions, i - 1)["end"])
    until = lambda i: F.when(i == n, F.char_length(text)).otherwise(F.get(regions, i)["start"])
    gap = lambda i: F.substring(text, before(i) + 1, until(i) - before(i))
    hidden = lambda i: F.when(i < n, F.regexp_replace(F.substring(text, F.get(regions, i)["start"] + 1, F.get(regions, i)["end"] - F.get(regions, i)["start"]), r"[^\r\n]", " ")).otherwise("")
    return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), n), lambda i: F.concat(gap(i), hidden(i))), "")).otherwise(text)


def touches(regions: Column, start: Column, end: Column) -> Column:
    return F.exists(regions, lambda r: (start < r["end"]) & (r["start"] < end))
