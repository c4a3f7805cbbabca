"""Normalizers: spellings of one value get one key.  Each maps a column to a column."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import phones

#: Forms of address and titles that are not part of a person's key.
TITLES = [
    "herr", "herrn", "frau", "hr", "fr", "dr", "prof", "professor", "dipl", "ing", "mag", "med", "rer", "nat", "pol", "phil", "oec", "hc", "ra", "rae", "rechtsanwalt",
]

REGISTRY: dict[str, Callable[[Column], Column]] = {}


def register(name: str):
    def put(f: Callable[[Column], Column]):
        if name in REGISTRY:
            raise ValueError(f"normalizer {name!r} is registered already")
        REGISTRY[name] = f
        return f

    return put


def get(name: str) -> Callable[[Column], Column]:
    return REGISTRY[name]


NOT_ASCII = r"[^\x00-\x7F]"


def nfkc(text: Column) -> Column:
    """NFKC form, in Arrow batches: Spark has no function for it.  ASCII texts are their own; filter them off first."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))

    return run(text)


def folded(text: Column) -> Column:
    """Case-folded: letters by way of their upper case, and a sharp s as two."""
    return F.replace(F.lower(F.upper(text)), F.lit("ß"), F.lit("ss"))


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


@register("casefold")
def casefold(x: Column) -> Column:
    return folded(collapsed(x))


@register("identity")
def identity(x: Column) -> Column:
    return x


@register("digits")
def digits(x: Column) -> Column:
    return F.regexp_replace(x, r"\D", "")


@register("strip_upper")
def strip_upper(x: Column) -> Column:
    return F.upper(F.regexp_replace(x, r"(?U)[\s.\-/]", ""))


@register("email")
def email(x: Column) -> Column:
    return F.lower(F.regexp_replace(x, r"(?U)\s+", ""))


@register("date_iso")
def date_iso(x: Column) -> Column:
    """Day first or ISO dates as Y-MM-DD, without a look at the calendar; else case-folded."""
    x = collapsed(x)
    day_first, iso = r"^(\d{1,2})[.\-/] ?(\d{1,2})[.\-/] ?(\d{4})$", r"^(\d{4})-(\d{1,2})-(\d{1,2})$"
    part = lambda p, i: F.lpad(F.regexp_extract(x, p, i), 2, "0")
    year = lambda p, i: F.regexp_extract(x, p, i)
    return F.when(x.rlike(day_first), F.concat_ws("-", year(day_first, 3), part(day_first, 2), part(day_first, 1))).when(x.rlike(iso), F.concat_ws("-", year(iso, 1), part(iso, 2), part(iso, 3))).otherwise(folded(x))


@register("expiry")
def expiry(x: Column) -> Column:
    x = collapsed(x)
    p = r"^(0[1-9]|1[0-2])\s*[/\-.]\s*(\d{4}|\d{2})$"
    return F.when(x.rlike(p), F.concat(F.regexp_extract(x, p, 1), F.lit("/"), F.right(F.regexp_extract(x, p, 2), F.lit(2)))).otherwise(folded(x))


@register("phone")
def phone(x: Column, region: str = "DE") -> Column:
    """A number of the numbering plan in full, ``+`` and digits; else its digits and plus signs; else case-folded."""
    bare = F.regexp_replace(x, r"[^0-9+]", "")
    return F.coalesce(phones.e164(x, region), F.when(bare != "", bare), casefold(x))


@register("person")
def person(x: Column) -> Column:
    """Titles at the front are left out, unless nothing else is there."""
    words = F.split(collapsed(x), " ")
    bare = F.transform(words, lambda w: folded(F.regexp_replace(w, "^[.,]+|[.,]+$", "")))
    title = F.transform(bare, lambda w: w.isin(*TITLES))
    first = F.array_position(F.transform(title, lambda t: F.when(t, "t").otherwise("n")), "n")
    rest = F.when(first > 0, F.slice(words, first.cast("int"), F.size(words))).otherwise(words)
    return folded(F.array_join(rest, " "))


def key_of(x: Column, compatible: Column, name: str) -> Column:
    """Key of a value by a named normalizer, given the value and its NFKC form, which most names ask for."""
    return get(name)(x if name in ("identity", "digits", "email", "phone") else compatible)


def normalize(x: Column, name: str) -> Column:
    """Key of a value by a named normalizer."""
    return key_of(x, nfkc(x), name)
