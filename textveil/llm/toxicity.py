"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words, pairs and pairs with one word between are hashed; a text has each feature once.  Training
keeps a rate for each coordinate and an L1 term, so few weights are not zero; those few, and not
the text, travel to the tasks that score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick, stored
from .hashing import Words, chunks
from .ngrams import grams

KINDS = ("1", "2", "skip")
BUCKETS = 1 << 20


def features(texts: pa.Array, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of each feature, repeats included."""
    parts = grams(Words(texts), KINDS, buckets)
    return np.concatenate([d for _, d in parts]), np.concatenate([c for c, _ in parts])


class Ftrl:
    """Per-coordinate FTRL-proximal state for logistic loss; coordinate ``buckets`` is the bias, without L1."""

    def __init__(self, buckets: int = BUCKETS, alpha: float = 1.0, beta: float = 1.0, l1: float = 6.0, l2: float = 0.1):
        self.z, self.n = np.zeros(buckets + 1), np.zeros(buckets + 1)
        self.buckets, self.alpha, self.beta, self.l1, self.l2 = buckets, alpha, beta, l1, l2

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        l1 = np.where(at == self.buckets, 0.0, self.l1)
        shrunk = np.sign(z) * np.maximum(np.abs(z) - l1, 0.0)
        return -shrunk / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)

    def learn(self, at: np.ndarray, label: int) -> None:
        """``at``: the distinct buckets of a text."""
        at = np.append(at, self.buckets)
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def train(docs: DataFrame, labels: DataFrame, label: str, learnable: Column, max_rows: int, epochs: int, doc_id: str, text: str, seed: int = 5, **settings) -> tuple[np.ndarray, np.ndarray, float]:
    """Buckets and weights that are not zero, and the bias.

    A sample of about ``max_rows`` labelled rows at most, taken by a hash of the id, is fitted;
    being bounded, its ids can be broadcast and one task can run over its features in order.
    """
    rows = labels.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{label}`").cast("int").alias("label"), F.xxhash64(F.lit(seed), F.col(f"`{doc_id}`").cast("string")).alias("h"))
    rows = rows.where(F.col("label").isin(0, 1) & learnable)
    n = rows.count()
    share = min(1.0, max_rows / max(n, 1))
    rows = rows.where(F.pmod("h", F.lit(1 << 20)) < int(share * (1 << 20)))
    texts = pick(docs, *dict.fromkeys([doc_id, text])).select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    texts = texts.join(F.broadcast(rows), "doc_id").select("h", "label", "text")

    def vectors(batches):
        for batch in batches:
            for part in chunks(batch):
                doc, code = features(part.column(2))
                key = np.unique(doc * (BUCKETS + 1) + code)
                ends = np.searchsorted(key, np.arange(part.num_rows + 1) * (BUCKETS + 1))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(key % (BUCKETS + 1), pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists], names=["h", "label", "at"])

    data = stored(texts.mapInArrow(vectors, "h bigint, label int, at array<int>"), "toxic-features")

    def fit(batches):
        # Both classes and all languages by turns: the order of the hash.  The features are kept
        # as one flat array for the further epochs, at most max_rows texts.
        model, kept = Ftrl(**settings), []
        for batch in batches:
            at = batch.column(2)
            flat, ends = at.flatten().to_numpy(), at.offsets.to_numpy() - at.offsets[0].as_py()
            kept.append((flat, ends, batch.column(1).to_numpy()))
            for i, y in enumerate(kept[-1][2]):
                model.learn(flat[ends[i] : ends[i + 1]].astype(np.int64), int(y))
        for _ in range(epochs - 1):
            for flat, ends, label_ in kept:
                for i, y in enumerate(label_):
                    model.learn(flat[ends[i] : ends[i + 1]].astype(np.int64), int(y))
        w = model.weights(np.arange(model.buckets + 1))
        used = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(w[used])], names=["at", "w"])

    # One partition: the sample is bounded by max_rows.
    found = data.repartition(1).sortWithinPartitions("h", "label").mapInArrow(fit, "at bigint, w double").toArrow()
    at, w = found.column("at").to_numpy(), found.column("w").to_numpy()
    bias = float(w[at == BUCKETS].sum())
    return at[at < BUCKETS], w[at < BUCKETS], bias


def toxicity(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = 24_000, epochs: int = 3, threshold: float = 0.3, doc_id: str = "doc_id", text: str = "text", **settings
) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted.

    Rows whose crc32 of the id as text leaves 2 modulo 4 are held out of the training.  Null
    texts count as empty and get the score of the bias; a null id counts as an empty text for the
    remainder; labels other than 0 and 1 are passed over; with no usable label every score is 0.5.
    """
    remainder = lambda c: F.pmod(F.crc32(F.coalesce(c.cast("string"), F.lit(""))), F.lit(4))
    at, w, bias = train(docs, labels, label, remainder(F.col("doc_id")) != 2, max_rows, epochs, doc_id, text, **settings)
    rows = pick(docs, *dict.fromkeys([doc_id, text]))
    kind = rows.schema[doc_id].dataType.simpleString()
    rows = rows.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))

    def score(batches):
        table = np.zeros(BUCKETS)
        table[at] = w
        for batch in batches:
            for part in chunks(batch):
                doc, code = features(part.column(1))
                hit = np.flatnonzero(table[code])
                key = np.unique(doc[hit] * BUCKETS + code[hit])
                total = bias + np.bincount(key // BUCKETS, weights=table[key % BUCKETS], minlength=part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(1 / (1 + np.exp(-np.clip(total, -35, 35))))], names=["doc_id", "score"])

    out = rows.mapInArrow(score, f"doc_id {kind}, score double")
    return out.select("doc_id", (remainder(F.col("doc_id")) == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
