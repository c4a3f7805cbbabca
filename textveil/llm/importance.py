"""Quality by importance resampling of hashed n-gram models, sampled by Gumbel top-k.

A text's weight is the ratio of its likelihood under a bag-of-n-grams model of target text to
that under a model of all raw text, both over hashed words and word pairs.  Adding independent
Gumbel noise to the log weights and keeping the k largest samples without replacement in
proportion to the weights.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pick, stored
from .hashing import WORD_PUNCT, Words, chunks
from .ngrams import grams

KINDS = ("1", "2")


def tokens(texts: pa.Array) -> Words:
    """Runs of letters and digits and runs of punctuation, as they are written."""
    return Words(texts, WORD_PUNCT, lower=False)


def gram_counts(texts: DataFrame, buckets: int) -> DataFrame:
    """(bucket, n) over the whole texts (column ``text``); each task adds up before anything is shuffled."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in chunks(batch):
                for code, _ in grams(tokens(part.column(0)), KINDS, buckets):
                    total += np.bincount(code, minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], names=["bucket", "n"])

    return texts.select(F.col("text")).mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def log_ratios(raw: DataFrame, target: DataFrame, buckets: int, smoothing: float = 1.0) -> np.ndarray:
    """log of target over raw probability of each bucket; ``buckets`` numbers, whatever the input."""
    found = raw.withColumnRenamed("n", "r").join(target.withColumnRenamed("n", "t"), "bucket", "full").toArrow()
    r, t = np.full(buckets, smoothing), np.full(buckets, smoothing)
    at = found.column("bucket").to_numpy()
    r[at] += found.column("r").fill_null(0).to_numpy()
    t[at] += found.column("t").fill_null(0).to_numpy()
    return np.log(t / t.sum()) - np.log(r / r.sum())


def kth_largest(rows: DataFrame, key: str, k: int, rounds: int = 8, cells: int = 4096) -> tuple[float, int]:
    """(value, how many of its ties are in) so that the rows above it and these make k; 0 < k < count.

    Each round counts the rows in ``cells`` equal cells of the interval that holds the k-th value
    and narrows it to one cell, so only ``cells`` numbers come to the driver.
    """
    low, high = rows.agg(F.min(key), F.max(key)).first()
    above = 0
    for _ in range(rounds):
        if not low < high:
            break
        width = (high - low) / cells
        cell = F.least(F.floor((F.col(key) - low) / width), F.lit(cells - 1)).cast("int")
        inside = rows.where((F.col(key) >= low) & (F.col(key) <= high))
        counts = {r.cell: (r.n, r.lo, r.hi) for r in inside.groupBy(cell.alias("cell")).agg(F.count("*").alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi")).collect()}
        for c in sorted(counts, reverse=True):
            n, lo, hi = counts[c]
            if above + n >= k:
                low, high = lo, hi
                break
            above += n
        if n == 1 or low == high:
            return low, k - above
    return low, k - above


def importance_resample(
    docs: DataFrame, labels: DataFrame, label: str = "quality", share: float | None = None, max_target: int = 20_000, buckets: int = 10_000, seed: int = 3, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per document: doc_id, log_weight, gumbel, kept.

    The target model is fitted on about ``max_target`` documents at most whose label is 1, taken
    by a hash of the id; the raw model counts every whole text.  ``share`` of the documents are
    sampled: by default the share of label 1 among the labelled.  Null texts count as empty and
    weigh 1 (log 0).  Noise depends on seed and id alone; rows that are equal in key, such as
    repeated ids with one text, are kept or left by their place among the ties.  With no label 1
    all weights are 1.
    """
    marks = labels.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{label}`").cast("int").alias("label")).where("label in (0, 1)")
    n, good = marks.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    rows = pick(docs, *dict.fromkeys([doc_id, text]))
    kind = rows.schema[doc_id].dataType.simpleString()
    rows = rows.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    part_of = min(1.0, max_target / max(good, 1))
    chosen = marks.where((F.col("label") == 1) & (F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id").cast("string")), F.lit(1 << 20)) < int(part_of * (1 << 20)))).select("doc_id").distinct()
    target = rows.join(F.broadcast(chosen), "doc_id", "left_semi")
    table = log_ratios(gram_counts(rows, buckets), gram_counts(target, buckets), buckets) if good else np.zeros(buckets)

    def weigh(batches):
        for batch in batches:
            for part in chunks(batch):
                total = np.zeros(part.num_rows)
                for code, doc in grams(tokens(part.column(1)), KINDS, buckets):
                    total += np.bincount(doc, weights=table[code], minlength=part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(total)], names=["doc_id", "log_weight"])

    out = rows.mapInArrow(weigh, f"doc_id {kind}, log_weight double")
    uniform = (F.pmod(F.xxhash64(F.lit(seed + 1), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    out = stored(out.withColumn("gumbel", -F.log(-F.log(uniform))).withColumn("key", F.col("log_weight") + F.col("gumbel")), "importance")
    count = out.count()
    k = round(count * (share if share is not None else (good / n if n else 1.0)))
    if k <= 0 or k >= count:
        return out.select("doc_id", "log_weight", "gumbel", F.lit(k > 0).alias("kept"))
    value, ties = kth_largest(out, "key", k)
    level = out.where(F.col("key") == value)
    if level.count() == ties:
        return out.select("doc_id", "log_weight", "gumbel", (F.col("key") >= value).alias("kept"))
    # Ties at the last key: the first of them in the order of their ids; equal rows are alike.
    spread = Window.partitionBy("key").orderBy("doc_id", "log_weight")
    placed = level.withColumn("kept", F.row_number().over(spread) <= ties)
    return out.where(F.col("key") != value).withColumn("kept", F.col("key") > value).unionByName(placed).select("doc_id", "log_weight", "gumbel", "kept")
