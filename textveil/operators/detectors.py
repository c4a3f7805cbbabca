"""Detectors that propose spans as rows: lists of names of any length, and models run over windows."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import chunks, merge, vault
from .catalogue import Catalogue

#: Names up to this number, and characters of all of them, are broadcast; longer lists are shuffled.
SMALL_LIST, SMALL_BYTES = 200_000, 32_000_000
#: Bits of the map of first words for each name, and of a map at most: 16 MB.
NAME_BITS, MOST_BITS = 64, 1 << 27
#: Bits of a bucket of Spark's bitmaps.
BUCKET = 32_768
_WORD = re.compile(r"\w+")
_OTHER = re.compile(r"[^\x00-\x7f]+")
#: Characters whose lower case is, or begins with, an ASCII letter.
_ODD = re.compile("[\u0130\u212a]")
#: A model: texts to an answer each, a list of (label, surface, place in the text or None, score).
Model = Callable[[list[str]], list[list[tuple[str, str, int | None, float]]]]


def listed_spans(docs: DataFrame, names: DataFrame, key: str = "doc_id", text: str = "text", score: float = 0.95) -> DataFrame:
    """key, start, end, text, type, score: at each word of ``docs`` (key, text) the longest of ``names`` (name, type) that begins there.

    Case is no matter; a name stands between word bounds.  Each word meets the names by their first word, or first two
    where they have more, an inverted index, so the text is read once whatever their number.  Words that begin no name
    go no further than the task that reads them: a bitmap of the names' first words, of bounded size, tells; a row of
    the others holds as many characters as the longest name has.
    Null and empty names, and those that begin with no word character, are nowhere.  A name of two types proposes
    both; overlaps stay, for merging has to see them all.
    """
    listed = names.select(F.trim("name").alias("name"), "type").where(F.col("name").rlike(r"(?U)^\w")).distinct()
    listed = listed.select(F.lower("name").alias("low"), F.char_length("name").alias("size"), "type").distinct()
    words_of = F.regexp_extract_all("low", F.lit(r"(?U)\w+"), F.lit(0))
    listed = vault._held(listed.withColumn("first", F.array_join(F.slice(words_of, 1, 2), "\n")))
    n, longest, volume = listed.agg(F.count("*"), F.max("size"), F.sum(F.octet_length("low"))).first()
    most = longest or 0
    marks = _first_words(listed, n)

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = 8 * len(marks) - 1
        for rows in batches:
            for one, value in zip(rows["key"], rows["text"], strict=True):
                at = [m.span() for m in _WORD.finditer(value)]
                # Some thousand words at a time.
                for i in range(0, len(at), 20_000):
                    some, after = at[i : i + 20_000], [*at[i + 1 : i + 20_001], (0, 0)][: len(at[i : i + 20_000])]
                    own = [value[s:e] for s, e in some]
                    coded = [_folded(w) for w in [*own, value[after[-1][0] : after[-1][1]]]]
                    single = [crc32(c) for c in coded[:-1]]
                    double = [crc32(b"\n" + c, h) for c, h in zip(coded[1:], single, strict=True)]
                    odd = [k for k in range(len(own)) if _ODD.search(value, some[k][0], max(some[k][1], after[k][1]))] if _ODD.search(value) else []
                    out = []
                    for more, codes in enumerate((single, double)):
                        bit = np.array(codes, np.int64) & last
                        hit = (marks[bit >> 3] >> (bit & 7)) & 1
                        hit[odd] = 1
                        out += [(some[k][0], own[k] + "\n" + value[after[k][0] : after[k][1]] if more else own[k], value[some[k][0] : some[k][0] + most + 1]) for k in np.flatnonzero(hit).tolist()]
                    if out:
                        yield pd.DataFrame({"key": [one] * len(out), "start": [x[0] for x in out], "words": [x[1] for x in out], "head": [x[2] for x in out]})

    kind = docs.schema[key].dataType.simpleString()
    cut = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text")).mapInPandas(words, f"key {kind}, start int, words string, head string")
    cut = cut.withColumn("words", F.lower("words"))
    small = n <= SMALL_LIST and (volume or 0) <= SMALL_BYTES
    met = cut.join(F.broadcast(listed) if small else listed, F.col("words") == F.col("first"))
    found = F.substring(F.col("head"), F.lit(1), F.col("size"))
    whole = ~F.substring(F.col("head"), F.col("size") + 1, F.lit(1)).rlike(r"(?U)^\w")
    fits = met.where((F.lower(found) == F.col("low")) & whole).select("key", "start", "size", "type", found.alias("text"))
    # Names differ, so a place has one of each size and type.
    kept = fits.withColumn("most", F.max("size").over(Window.partitionBy("key", "start"))).where(F.col("size") == F.col("most"))
    return kept.select(F.col("key").alias(key), "start", (F.col("start") + F.col("size")).alias("end"), "text", "type", F.lit(score).alias("score"))


def _folded(word: str) -> bytes:
    """A word in lower case, where all that isn't ASCII is alike: Spark's lower case and Python's agree on the rest."""
    return (word if word.isascii() else _OTHER.sub("?", word)).lower().encode()


def _first_words(listed: DataFrame, n: int) -> np.ndarray:
    """A bitmap of the checksums of what ``n`` names begin with (``first``), folded: bounded, however long the list."""
    bits = max(BUCKET, min(MOST_BITS, 1 << (NAME_BITS * n).bit_length()))
    code = F.crc32(F.lower(F.regexp_replace("first", r"[^\x00-\x7f]+", "?")).cast("binary")).bitwiseAND(F.lit(bits - 1)) + 1
    parts = listed.select(code.alias("code")).groupBy(F.bitmap_bucket_number("code").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("code")).alias("m"))
    out = np.zeros((bits // BUCKET, BUCKET // 8), np.uint8)
    for row in parts.toLocalIterator():
        out[row.b - 1] = np.frombuffer(row.m, np.uint8)
    return out.ravel()


def model_spans(docs: DataFrame, make: Callable[[], Model], catalogue: Catalogue, most: int = 1000, batch: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, start, end, text, type, label, score of what a model finds in ``docs`` (key, text).

    Windows of all texts are flattened into batches of ``batch``, across texts; ``make`` builds the model once a task.
    Labels are routed to types by ``catalogue``: those that no enabled type has, and answers that can't be placed
    in the text, are left out.  Blank and null texts are not shown to the model.  ``key`` tells texts apart.
    """
    whole = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    windows = chunks.chunk_documents(whole, most).where(F.col("text").rlike(r"(?U)\S"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for rows in batches:
            model = model or make()
            for i in range(0, len(rows), batch):
                some = rows.iloc[i : i + batch]
                answers = model(list(some["text"]))
                if len(answers) != len(some):
                    raise ValueError(f"a model gave {len(answers)} answers to {len(some)} texts")
                out = [(d, c, s, *a) for d, c, s, found in zip(some["doc_id"], some["chunk"], some["start"], answers, strict=True) for a in found]
                yield pd.DataFrame(out, columns=["doc_id", "chunk", "start", "label", "surface", "at", "score"]).astype({"at": "Int32"})

    kind = docs.schema[key].dataType.simpleString()
    found = windows.mapInPandas(run, f"doc_id {kind}, chunk int, start int, label string, surface string, at int, score double")
    typed = catalogue.routed(found).where("type IS NOT NULL")
    return chunks.placed_spans(typed, whole).withColumnRenamed("doc_id", key)


def with_proposals(docs: DataFrame, spans: DataFrame, key: str = "doc_id", name: str = "proposed", source: str = "model") -> DataFrame:
    """``docs`` with the ``spans`` of each row as an array, for ``detect`` and ``pseudonymize``; a row without any has an empty one.

    ``key`` must differ between rows, and is the only name that both tables may share.
    """
    label = F.col("label") if "label" in spans.columns else F.lit(None).cast("string")
    one = merge.span(F.col("start"), F.col("end"), F.col("text"), F.col("type"), F.col("score"), F.lit(source), label)
    lists = spans.select(F.col(key).alias("__key"), one.alias("s")).groupBy("__key").agg(F.array_sort(F.collect_list("s")).cast(merge.SPANS).alias(name))
    return docs.join(lists, F.col(key) == F.col("__key"), "left").drop("__key").withColumn(name, F.coalesce(name, F.array().cast(merge.SPANS)))
