"""Numbering plans: which digits are a telephone number, and how it is written in full.

A plan is a table of prefixes (country code, or country and area code) with the lengths of what
follows; the longest prefix of a number decides.  It becomes one pattern, a trie of digits, so that
checking a number is a match in the JVM without a join, and no digit is looked at twice.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of E.164: country code, and least and most digits of the national number.
COUNTRIES = """
1 10 10   7 10 10   20 8 10   27 9 9    30 10 10  31 9 11   32 8 9    33 9 9    34 9 9    36 8 9    39 6 12   40 9 9    41 9 12   43 4 13
44 9 10   45 8 8    46 7 13   47 8 8    48 9 9    49 4 15   51 8 9    52 10 10  53 6 8    54 10 11  55 10 11  56 9 9    57 10 10  58 10 10
60 8 10   61 9 10   62 7 13   63 8 11   64 8 10   65 8 8    66 8 9    81 9 10   82 8 11   84 9 10   86 10 12  90 10 10  91 10 10  92 9 10
93 9 9    94 9 9    95 7 10   98 10 10  212 9 9   213 8 9   216 8 8   218 9 9   220 7 7   221 9 9   225 10 10 233 9 9   234 8 10  237 9 9
243 9 9   244 9 9   250 9 9   251 9 9   254 9 9   255 9 9   256 9 9   258 8 9   260 9 9   263 9 10  350 8 8   351 9 9   352 4 12  353 7 9
354 7 7   355 8 9   356 8 8   357 8 8   358 5 12  359 8 9   370 8 8   371 8 8   372 7 8   373 8 8   374 8 8   375 9 9   376 6 9   377 8 9
378 6 10  380 9 9   381 8 10  382 8 9   383 8 9   385 8 9   386 8 8   387 8 9   389 8 8   420 9 9   421 9 9   423 7 9   502 8 8   503 8 8
504 8 8   505 8 8   506 8 8   507 7 8   591 8 8   593 8 9   595 9 9   598 8 8   852 8 8   853 8 8   855 8 9   880 8 10  886 8 9   961 7 8
962 8 9   963 8 9   964 8 10  965 7 8   966 9 9   967 7 9   968 7 8   970 8 9   971 8 9   972 8 9   973 8 8   974 7 8   976 8 8   977 9 10
992 9 9   994 9 9   995 9 9   996 9 9   998 9 9
"""
#: Fixed values of national plans: country and area code, least and most digits of the whole national number; 0 0 is not in use.
AREAS = """
49 0 0       492 6 11     493 6 11     494 6 11     495 6 11     496 6 11     497 6 11     498 6 11     499 6 11
49800 10 10  49180 9 10   49137 10 10  49900 10 10  49700 11 11  4932 11 11
49150 11 11  49151 11 11  49152 11 11  49155 11 11  49156 11 11  49157 11 11  49159 11 11  49160 10 11
49162 10 10  49163 10 10  49170 10 10  49171 10 10  49172 10 10  49173 10 10  49174 10 10  49175 10 10  49176 11 11  49177 10 10  49178 10 10  49179 10 10
43 0 0       431 7 13     432 7 13     433 7 13     434 7 13     435 7 13     436 7 13     437 7 13
41 0 0       412 9 9      413 9 9      414 9 9      415 9 9      416 9 9      417 9 9      418 9 9      419 9 9
33 0 0       331 9 9      332 9 9      333 9 9      334 9 9      335 9 9      336 9 9      337 9 9      338 9 9      339 9 9
1 0 0        12 10 10     13 10 10     14 10 10     15 10 10     16 10 10     17 10 10     18 10 10     19 10 10
"""
#: Country code and trunk prefix of the regions whose national spellings are read.
REGIONS = {"DE": ("49", "0"), "AT": ("43", "0"), "CH": ("41", "0"), "FR": ("33", "0"), "GB": ("44", "0"), "NL": ("31", "0"), "BE": ("32", "0"), "IT": ("39", ""), "ES": ("34", ""), "PL": ("48", ""), "US": ("1", "1")}

Plan = dict[str, tuple[int, int]]


def countries(table: str = COUNTRIES) -> Plan:
    """Prefix to least and most digits that follow it."""
    cells = table.split()
    return {p: (int(lo), int(hi)) for p, lo, hi in zip(cells[::3], cells[1::3], cells[2::3], strict=True)}


def areas(table: str = AREAS) -> Plan:
    """The countries' plan with area codes, each to the digits that follow the whole prefix; (0, -1): not in use."""
    plan = countries()
    codes = sorted(plan, key=len, reverse=True)
    for prefix, (lo, hi) in countries(table).items():
        area = len(prefix) - len(next(c for c in codes if prefix.startswith(c)))
        plan[prefix] = (lo - area, hi - area) if hi else (0, -1)
    return plan


def pattern(plan: Plan) -> str:
    """Pattern of full numbers (``+`` and digits) that fit the longest of the plan's prefixes that they begin with."""
    inner = {p[:i] for p in plan for i in range(len(p))}

    def node(prefix: str, rule: tuple[int, int] | None) -> str:
        rule = plan.get(prefix, rule)
        below = [d for d in "0123456789" if prefix + d in plan or prefix + d in inner] if prefix in inner else []
        parts = [d + node(prefix + d, rule and (rule[0] - 1, rule[1] - 1)) for d in below]
        if rule and rule[1] >= 0:
            parts.append((f"(?![{''.join(below)}])" if below else "") + f"[0-9]{{{max(rule[0], 0)},{rule[1]}}}")
        return "(?:" + "|".join(parts or ["(?!)"]) + ")"

    return rf"^\+{node('', None)}$"


VALID, POSSIBLE = pattern(areas()), pattern(countries())


def spellings(x: Column, region: str = "DE") -> Column:
    """Full numbers (``+`` and digits) that ``x`` may stand for, likelier ones first.

    ``+`` or ``00`` comes before a country code, and a ``(0)`` is no part of the number.  Without them it is a
    number of the region with or without its trunk prefix, or one whose country code lacks its mark; with letters
    beside its digits, as of a file number, it needs the trunk prefix.
    """
    code, trunk = REGIONS[region]
    bare = F.regexp_replace(F.regexp_replace(x, r"\(0\)", ""), r"[^0-9+]", "")
    digits = F.replace(bare, F.lit("+"), F.lit(""))
    rest = lambda n: F.substring(digits, F.lit(n + 1), F.char_length(digits))
    full = lambda d: F.concat(F.lit("+"), d)
    national = full(F.concat(F.lit(code), F.when(digits.startswith(trunk), rest(len(trunk))).otherwise(digits) if trunk else digits))
    marked = F.when(bare.startswith("+"), F.array(full(digits))).when(digits.startswith("00"), F.array(full(rest(2))))
    plain, named = ~x.rlike(r"\p{L}"), digits.startswith(trunk)
    return marked.otherwise(F.array(F.when(plain | named, national), F.when(plain & digits.startswith(code), full(digits))))


def e164(x: Column, region: str = "DE", fits: str = VALID) -> Column:
    """``x`` as a full number, if one of its spellings fits the plan, else null."""
    return F.get(F.filter(spellings(x, region), lambda n: F.coalesce(n.rlike(fits), F.lit(False))), F.lit(0))


def valid(x: Column, region: str = "DE") -> Column:
    """Is ``x`` a number of the numbering plan, with an area in use and the right length?  Null is not."""
    return e164(x, region).isNotNull()


def possible(x: Column, region: str = "DE") -> Column:
    """Has ``x`` a length that numbers of its country have?  Areas are not looked at.  Null is not."""
    return e164(x, region, POSSIBLE).isNotNull()
