"""Placeholders ``[[TYPE_SUFFIX]]``: suffix code, rendering and parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The grammar of placeholders and of type names.
PLACEHOLDER = r"\[\[([A-Z][A-Z0-9_]*)_([A-Z]+[0-9]+)\]\]"
TYPE_NAME = r"^[A-Z][A-Z0-9_]*$"


def letters(block: Column) -> Column:
    """0 is A, 25 Z, 26 AA, and so on, without a zero digit."""
    start = F.struct((block.cast("bigint") + 1).alias("n"), F.lit("").alias("s"))
    step = lambda acc, _: F.struct(
        F.floor((acc["n"] - 1) / 26).cast("bigint").alias("n"),
        F.when(acc["n"] > 0, F.concat(F.char((acc["n"] - 1) % 26 + 65), acc["s"])).otherwise(acc["s"]).alias("s"),
    )
    return F.aggregate(F.sequence(F.lit(1), F.lit(8)), start, step, lambda acc: acc["s"])


def suffix(index: Column) -> Column:
    """Letters for each nine numbers, then a digit from 1 to 9; a negative index is an error."""
    good = F.when(index < 0, F.raise_error(F.lit("a suffix index is not negative")).cast("string"))
    return F.coalesce(good, F.concat(letters(F.floor(index / 9)), (index % 9 + 1).cast("string")))


def render(kind: Column, index: Column) -> Column:
    return F.concat(F.lit("[["), kind, F.lit("_"), suffix(index), F.lit("]]"))


def found(text: Column, group: int = 0) -> Column:
    """All placeholders of a text, or their types (1) or suffixes (2)."""
    return F.regexp_extract_all(text, F.lit(PLACEHOLDER), F.lit(group))


def contains(text: Column) -> Column:
    return F.coalesce(text.rlike(PLACEHOLDER), F.lit(False))
