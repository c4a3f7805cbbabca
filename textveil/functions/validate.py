"""Validators: does a value have the form, and the check digits, of its type?  Column to boolean column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import phones

#: Fixed value: the e-mail pattern, without what must not stand beside it.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)*\.[A-Za-z]{2,}"
IPV4 = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?:\.(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)){3}"
IPV6 = r"(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=(?:[^:]*:){2,7}[^:]*$)(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})*)?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})*)?"

REGISTRY: dict[str, Callable[[Column], Column]] = {}


def register(name: str):
    def put(f: Callable[[Column], Column]):
        if name in REGISTRY:
            raise ValueError(f"validator {name!r} is registered already")
        REGISTRY[name] = f
        return f

    return put


def get(name: str) -> Callable[[Column], Column]:
    return REGISTRY[name]


def compact(x: Column) -> Column:
    return F.upper(F.regexp_replace(x, r"(?U)[\s.\-/]", ""))


def chars(x: Column) -> Column:
    return F.filter(F.split(x, ""), lambda c: c != "")


@register("email_syntax")
def email_syntax(x: Column) -> Column:
    return F.trim(x).rlike(f"^(?:{EMAIL})$")


@register("iban_mod97")
def iban_mod97(x: Column) -> Column:
    """15 to 34 ASCII letters and digits, country and check digits first, remainder 1 modulo 97."""
    c = compact(x)
    turned = F.concat(F.substring(c, F.lit(5), F.char_length(c)), F.substring(c, 1, 4))
    value = lambda ch: F.when(ch.rlike("^[0-9]$"), F.ascii(ch) - 48).otherwise(F.ascii(ch) - 55)
    rest = F.aggregate(chars(turned), F.lit(0), lambda a, ch: ((a * F.when(value(ch) > 9, 100).otherwise(10) + value(ch)) % 97).cast("int"))
    return F.when(c.rlike(r"^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$"), rest == 1).otherwise(F.lit(False))


@register("luhn")
def luhn(x: Column) -> Column:
    """12 to 19 digits with the Luhn check."""
    c = compact(x)
    return F.when(c.rlike(r"^[0-9]{12,19}$"), F.call_function("luhn_check", c)).otherwise(F.lit(False))


def steuer_id(x: Column) -> Column:
    """11 digits, one of the first ten repeated, ISO 7064 MOD 11,10 check digit."""
    c = compact(x)
    ten = F.slice(chars(c), 1, 10)
    kinds = F.array_distinct(ten)
    repeated = F.size(F.filter(kinds, lambda d: F.size(F.filter(ten, lambda e: e == d)) > 1))

    def step(p: Column, d: Column) -> Column:
        s = (p + d.cast("int")) % 10
        return ((F.when(s == 0, 10).otherwise(s) * 2) % 11).cast("int")

    check = (11 - F.aggregate(ten, F.lit(10), step)) % 10
    return F.when(c.rlike(r"^[0-9]{11}$"), F.size(kinds).isin(8, 9) & (repeated == 1) & (check == F.substring(c, 11, 1).cast("int"))).otherwise(F.lit(False))


@register("tax_de")
def tax_de(x: Column) -> Column:
    c = compact(x)
    return steuer_id(x) | c.rlike(r"^[0-9]{10,11}$") | c.rlike(r"^DE[0-9]{9}$")


@register("bank_routing_de")
def bank_routing_de(x: Column) -> Column:
    return compact(x).rlike(r"^(?:[0-9]{8}|[A-Z]{4}[A-Z]{2}[A-Z0-9]{2}(?:[A-Z0-9]{3})?)$")


@register("postal_de")
def postal_de(x: Column) -> Column:
    return compact(x).rlike(r"^[0-9]{5}$")


@register("ip_parse")
def ip_parse(x: Column) -> Column:
    return F.trim(x).rlike(f"^(?:{IPV4}|{IPV6})$")


@register("expiry_shape")
def expiry_shape(x: Column) -> Column:
    return F.trim(x).rlike(r"^(?:0[1-9]|1[0-2])\s*[/\-.]\s*(?:\d{4}|\d{2})$")


@register("cvv_shape")
def cvv_shape(x: Column) -> Column:
    return F.trim(x).rlike(r"^\d{3,4}$")


@register("phone_shape")
def phone_shape(x: Column) -> Column:
    """Seven digits at least, nothing but what numbers are spelled with, and a length that the country has; the area may be any."""
    n = F.char_length(F.regexp_replace(x, r"\D", ""))
    return (n >= 7) & F.trim(x).rlike(r"^\+?[\d\s()/.\-]+$") & phones.possible(x)


@register("phone_valid")
def phone_valid(x: Column) -> Column:
    """A number of the numbering plan: an area in use, and its length."""
    return phones.valid(x)
