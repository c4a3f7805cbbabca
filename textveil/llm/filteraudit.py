"""Filter interaction audit over a packed bitmap index.

Each task keeps a bit for every row and filter, label and part: rows are grouped by part, and a
part's bitmap is a range of 64-bit words.  What a set of filters leaves of a part is an AND-NOT
of words and a population count; the counts of all 32 sets are summed over tasks.  Every order
of the filters reads its steps from those sums, so no order is run by itself.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick, sized, stored
from .hashing import NONBLANK, U, Words, chunks, mix

#: The letters of the filters; a set of filters is the sum of 2 ** position.
FILTERS = "ABCDE"
ALL = (1 << len(FILTERS)) - 1
#: The characters of which a text of filter D holds one.
MARKS = "#$%&*|"
_IS_MARK = np.array([chr(b) in MARKS for b in range(256)])
_IS_UPPER = np.array([0x41 <= b <= 0x5A for b in range(256)])


def text_failures(texts: pa.Array) -> np.ndarray:
    """The filters that each text fails by itself, A to D; null counts as empty."""
    words = Words(texts, NONBLANK, lower=False)
    buf, n = words.buffer, words.count()
    doc = np.repeat(np.arange(len(buf)), n)
    key = mix(words.hash ^ mix(doc.astype(U), 3))
    order = np.argsort(key)
    again = order[1:][key[order][1:] == key[order][:-1]]
    distinct = n - np.bincount(doc[again], minlength=len(buf))

    def count(table: np.ndarray) -> np.ndarray:
        upto = np.concatenate([[0], np.cumsum(table)])
        return upto[buf.offsets[1:]] - upto[buf.offsets[:-1]]

    chars = count((buf.bytes & 0xC0) != 0x80) - 1  # the line feed after each text
    failed = [n < 50, 100 * distinct < 65 * n, 100 * count(_IS_UPPER[buf.bytes]) > 5 * chars, count(_IS_MARK[buf.bytes]) > 0]
    return sum(f.astype(np.int32) << i for i, f in enumerate(failed))


def packed(bits: np.ndarray, at: np.ndarray, words: int) -> np.ndarray:
    """64-bit words with the bits ``at`` set where ``bits`` are."""
    flat = np.zeros(words * 64, bool)
    flat[at] = bits
    return np.packbits(flat, bitorder="little").view(np.uint64)


def bitmap_counts(part: np.ndarray, failed: np.ndarray, good: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """counts[p, s]: rows of part p (parts count from 0, none is empty) that fail none of set s, all, good and toxic ones."""
    order = np.argsort(part, kind="stable")
    size = np.bincount(part)
    words = (size + 63) // 64
    start = np.cumsum(words) - words
    at = np.arange(len(part)) + np.repeat(start * 64 - (np.cumsum(size) - size), size)
    total = int(words.sum())
    fails = [packed(failed[order] >> i & 1 > 0, at, total) for i in range(len(FILTERS))]
    labels = [packed(x[order], at, total) for x in (good, toxic)]
    alive = [packed(np.ones(len(part), bool), at, total)]
    out = np.zeros((len(size), ALL + 1, 3), np.int64)
    for s in range(ALL + 1):
        if s:
            last = s.bit_length() - 1
            alive.append(alive[s ^ (1 << last)] & ~fails[last])
        for k, bits in enumerate((alive[s], *(alive[s] & x for x in labels))):
            out[:, s, k] = np.add.reduceat(np.bitwise_count(bits).astype(np.int64), start)
    return out


def _orders() -> Column:
    """All orders of the filters, each with the sets that its steps have applied, the empty one first."""
    rows = []
    for order in itertools.permutations(range(len(FILTERS))):
        sets = itertools.accumulate((1 << i for i in order), initial=0)
        rows.append(F.struct(F.lit("".join(FILTERS[i] for i in order)).alias("filter_order"), F.array(*[F.lit(s) for s in sets]).alias("sets")))
    return F.array(*rows)


def filter_audit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """One row per part, order of the five filters and step: part, filter_order, step, kept, removed,
    redundant, unique_fails, good_lost, toxic_lost, shapley.

    Filters: A under 50 words; B distinct words under 65 %; C capitals over 5 % of the characters;
    D a character of ``MARKS``; E a text that a smaller id has too.  Null texts count as empty,
    null parts as the empty string, and the two parts are one.  A null id is not smaller than another, nor is any smaller than it;
    rows that repeat id and text don't make each other fail E.  A label holds if any label row of the
    id says so; null labels and label rows without an id say nothing.  An empty table gives no rows.
    """
    source = pick(docs, *dict.fromkeys([doc_id, part, text]))
    kind = source.schema[doc_id].dataType.simpleString()
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    source = source.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), F.unhex(F.md5(body.cast("binary"))).alias("digest"), body.alias("text"))

    def judge(batches):
        for batch in batches:
            for piece in chunks(batch):
                yield pa.RecordBatch.from_arrays([*piece.columns[:3], pa.array(text_failures(piece.column(3)), pa.int32())], names=["doc_id", "part", "digest", "failed"])

    rows = stored(source.mapInArrow(judge, f"doc_id {kind}, part string, digest binary, failed int"), "judged")
    # The first document of each text, joined by id: a text of very many copies has one row on that side and even keys on the other.
    firsts = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("is_first", F.lit(True))
    said = pick(labels, "doc_id", "quality", "toxic").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    rows = rows.join(firsts, ["doc_id", "digest"], "left").join(sized(said), "doc_id", "left")
    copy = F.col("doc_id").isNotNull() & F.col("is_first").isNull()
    holds = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    rows = rows.select("part", F.col("failed").bitwiseOR(F.when(copy, 16).otherwise(0)).alias("failed"), holds("good"), holds("toxic"))

    def index(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            coded = batch.column(0).dictionary_encode()
            counts = bitmap_counts(coded.indices.to_numpy(), *[batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2, 3)])
            n = len(counts)
            flat = counts.reshape(n * (ALL + 1), 3)
            yield pa.RecordBatch.from_arrays(
                [coded.dictionary.take(pa.array(np.repeat(np.arange(n), ALL + 1))), pa.array(np.tile(np.arange(ALL + 1), n), pa.int32()), *[pa.array(flat[:, k]) for k in range(3)]],
                names=["part", "set", "n", "good", "toxic"],
            )

    sums = rows.mapInArrow(index, "part string, set int, n bigint, good bigint, toxic bigint").groupBy("part", "set").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])
    left = sums.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("set", "n", "good", "toxic"))).alias("left"))
    left = left.select("part", *[F.col(f"left.{c}").alias(c) for c in ("n", "good", "toxic")])
    n = lambda s: F.get("n", F.lit(s) if isinstance(s, int) else s)
    weight = [math.factorial(k) * math.factorial(len(FILTERS) - 1 - k) for k in range(len(FILTERS))]
    shares, alone = [], []
    for i in range(len(FILTERS)):
        own = 1 << i
        shares.append(sum(weight[s.bit_count()] * (n(s) - n(s | own)) for s in range(ALL + 1) if not s & own))
        alone.append(n(ALL ^ own) - n(ALL))
    left = left.withColumns({"shares": F.array(*shares), "alone": F.array(*alone)})
    steps = left.withColumn("o", F.explode(_orders())).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    steps = steps.withColumns({"before": F.get("o.sets", F.col("step") - 1), "after": F.get("o.sets", F.col("step"))})
    own = (F.col("after") - F.col("before")).cast("int")
    which = F.instr(F.lit(FILTERS), F.substring("o.filter_order", F.col("step"), F.lit(1))) - 1
    lost = lambda c: F.get(c, F.col("before")) - F.get(c, F.col("after"))
    return steps.select(
        "part", "o.filter_order", "step", n(F.col("after")).alias("kept"), lost("n").alias("removed"), (n(0) - n(own) - lost("n")).alias("redundant"), F.get("alone", which).alias("unique_fails"),
        lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), F.get("shares", which).alias("shapley"),
    )
