"""Long texts in overlapping windows for a model, and its answers placed in the text again."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters that windows share, where windows end best (first choice first), and how far a reported place may be off.
OVERLAP, BREAKS, NEAR = 200, ("\n\n", "\n", " "), 64


def _cuts(value: str, most: int, shared: int) -> Iterator[tuple[int, int]]:
    """Bounds of the windows of a text.  Each looks at its own characters only, so a text takes time in proportion to its length."""
    begin, n = 0, len(value)
    while n - begin > most:
        full = begin + most
        half = begin + most // 2
        end = next((at + len(b) for b in BREAKS if (at := value.rfind(b, half, full)) >= 0), full)
        yield begin, end
        begin = end - shared if end - shared > begin else end
    yield begin, n


def chunk_documents(docs: DataFrame, most: int, overlap: int = OVERLAP, text: str = "text") -> DataFrame:
    """Windows of up to ``most`` characters: the other columns, ``chunk`` (from 0), ``start`` and ``text``.

    A window ends after the last paragraph, line or word break in its second half, else where it is
    full.  The next begins ``overlap`` (at most a quarter of ``most``) before that end; where that
    would not advance, at the end itself.  A short, empty or null text is one window.
    """
    if most < 1:
        raise ValueError("a window holds one character at least")
    whole, shared = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")), max(0, min(overlap, most // 4))

    @F.pandas_udf("array<struct<start:int,text:string>>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda value: [{"start": begin, "text": value[begin:end]} for begin, end in _cuts(value, most, shared)])

    rest = [F.col(f"`{c}`") for c in docs.columns if c != text]
    out = docs.select(*rest, F.posexplode(run(whole)).alias("chunk", "__cut"))
    return out.select(*rest, "chunk", F.col("__cut.start").alias("start"), F.col("__cut.text").alias(text))


def located(text: Column, surface: Column, hint: Column) -> Column:
    """Where ``surface`` is in ``text``: at ``hint``, else first within NEAR characters of it, else its only place; null if none.

    A null hint is the text's beginning; an empty surface is nowhere.
    """
    at, size = F.coalesce(hint, F.lit(0)), F.char_length(surface)
    low = F.greatest(F.lit(0), at - NEAR)
    near = F.instr(F.substring(text, low + 1, F.greatest(at + size + NEAR - low, F.lit(0))), surface)
    first = F.instr(text, surface)
    alone = (first > 0) & (F.instr(F.substring(text, first + 1, F.char_length(text)), surface) == 0)
    return F.when(size > 0, F.when((at >= 0) & (F.substring(text, at + 1, size) == surface), at).when(near > 0, low + near - 1).when(alone, first - 1))


def placed_spans(found: DataFrame, docs: DataFrame) -> DataFrame:
    """Model answers ``found`` (doc_id, chunk, start: the window's, type, label, surface, at: in the window, score) in ``docs`` (doc_id, text).

    Gives doc_id, start, end, text, type, label, score.  Answers that can't be placed are left out;
    of those that windows share, one start, end and type, that of the first window stays.
    """
    both = found.withColumnRenamed("start", "window").join(docs.select("doc_id", F.col("text").alias("doc")), "doc_id")
    both = both.withColumn("start", located(F.col("doc"), F.col("surface"), F.col("window") + F.coalesce("at", F.lit(0)))).where("start IS NOT NULL")
    both = both.withColumn("end", F.col("start") + F.char_length("surface"))
    first = both.groupBy("doc_id", "start", "end", "type").agg(F.min_by(F.struct("surface", "label", "score"), F.struct("chunk", "label", "score")).alias("s"))
    return first.select("doc_id", "start", "end", F.col("s.surface").alias("text"), "type", "s.label", "s.score")
