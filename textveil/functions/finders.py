"""Finders: rules that propose spans of a type, each a column of texts to an array of spans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import phones
from .matching import SPAN, checked_spans, spans
from .validate import EMAIL, iban_mod97, ip_parse, luhn

#: Patterns of the finders.
EMAIL_FIND = rf"(?<![\w.+-]){EMAIL}(?![\w-])"
IBAN_FIND = r"[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{2,4}){2,8}\b"
CARD_FIND = r"\d(?:[ -]?\d){11,18}\b"
IPV4_FIND = r"(?:\d{1,3}\.){3}\d{1,3}\b"
IPV6_FIND = r"(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}\b"
VAT_FIND = r"\bDE\d{9}\b"
PHONE_FIND = (
    r"(?<![\w.,/+-])(?<!\d )(?:(?:\+|00)[1-9]\d{0,2}[ /-]?(?:\(0?\d{1,5}\)[ /-]?)?\d{2,5}(?:[ /-]?\d{2,8}){1,4}"
    r"|0\d{2,4}[ /-]\d{4,8}(?:[ -]\d{2,6}){0,2}|0\d{8,12})(?![\w./-]*\d)"
)

REGISTRY: dict[str, Callable[[Column], Column]] = {}


def register(name: str):
    def put(f: Callable[[Column], Column]):
        if name in REGISTRY:
            raise ValueError(f"finder {name!r} is registered already")
        REGISTRY[name] = f
        return f

    return put


def get(name: str) -> Callable[[Column], Column]:
    return REGISTRY[name]


def _guarded(guard: Column, found: Column) -> Column:
    """A cheap look first: most texts don't hold what a costly pattern needs."""
    return F.when(guard, found).otherwise(F.array().cast(SPAN))


@register("email")
def find_email(text: Column) -> Column:
    return _guarded(text.contains("@"), spans(text, EMAIL_FIND))


@register("iban")
def find_iban(text: Column) -> Column:
    return _guarded(text.rlike(r"[A-Z]{2}\d{2}"), checked_spans(text, IBAN_FIND, iban_mod97))


@register("card")
def find_card(text: Column) -> Column:
    return _guarded(text.rlike(r"\d(?:[ -]?\d){11}"), checked_spans(text, CARD_FIND, luhn))


@register("ip")
def find_ip(text: Column) -> Column:
    v4 = _guarded(text.rlike(r"\d\.\d"), checked_spans(text, IPV4_FIND, ip_parse))
    v6 = _guarded(text.rlike(r":[0-9A-Fa-f]{0,4}:"), checked_spans(text, IPV6_FIND, ip_parse))
    return F.concat(v4, v6)


@register("vat_de")
def find_vat(text: Column) -> Column:
    return _guarded(text.contains("DE"), spans(text, VAT_FIND))


@register("phone")
def find_phone(text: Column) -> Column:
    """By the usual spellings and the numbering plan; dates and file numbers don't fit them."""
    return _guarded(text.rlike(r"(?:\+|\b0)\d"), F.filter(spans(text, PHONE_FIND), lambda s: phones.valid(s["text"])))
