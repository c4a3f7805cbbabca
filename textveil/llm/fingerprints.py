"""Document fingerprints from improbable byte windows, after the published similarity digest.

Every window of ``WINDOW`` bytes has an entropy (of order two, so a whole number of equal byte
pairs gives it exactly); how rare that entropy is in the corpus ranks the window.  A window that
is the rarest of enough runs of neighbours is a feature.  Features go into Bloom filters, a new
one after every ``FEATURES``; two chains of filters are alike as far as their bits overlap beyond chance.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, small_batches
from .hashing import U, Buffer, chunks, mix, ranges

#: Bytes of a window, windows of a run, and runs in which a window must be the rarest.
WINDOW, RUN, NEEDED = 16, 12, 3
#: Equal byte pairs of a window, and those from which on it is too plain (one byte over and over) to be a feature.
PAIRS, PLAIN = WINDOW * (WINDOW - 1) // 2 + 1, WINDOW * (WINDOW - 1) // 6
#: Bits of a filter, bits set by a feature, features of a filter.
BITS, HASHES, FEATURES = 2048, 5, 160
#: Share of the way from chance to full overlap that counts as none.
CUTOFF = 0.1
#: Rows in a batch: they carry whole texts.
BATCH_ROWS = 500
#: Pairs of filters compared at once.
PAIR_BLOCK = 20_000


def equal_pairs(data: np.ndarray) -> np.ndarray:
    """Equal byte pairs within each window of ``data``; windows start at every byte that has a whole one."""
    n = len(data) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    ahead, back = np.zeros(len(data), np.uint8), np.zeros(len(data), np.uint8)
    for k in range(1, WINDOW):
        same = (data[k:] == data[:-k]).view(np.uint8)
        ahead[:-k] += same
        back[k:] += same
    # A step to the right loses the first byte's pairs and gains the new byte's, but for its pair with the byte that left.
    first = int(sum((data[k:WINDOW] == data[: WINDOW - k]).sum() for k in range(1, WINDOW)))
    gained = back[WINDOW:].astype(np.int64)
    return first + np.concatenate([[0], np.cumsum(gained - ahead[: n - 1])])


def windows(buf: Buffer) -> tuple[np.ndarray, np.ndarray]:
    """Number of windows of each text, and each window's equal byte pairs; the buffer's line feeds are in none."""
    size = np.diff(buf.offsets) - 1
    n = np.maximum(size - WINDOW + 1, 0)
    return n, equal_pairs(buf.bytes)[ranges(buf.offsets[:-1], n)] if n.sum() else np.zeros(0, np.int64)


def ranks(histogram: np.ndarray) -> np.ndarray:
    """Rank of each number of equal pairs: the rarer in the corpus the lower; plain windows come last."""
    order = np.lexsort((np.arange(PAIRS), histogram))
    out = np.empty(PAIRS, np.int64)
    out[order] = np.arange(PAIRS)
    out[PLAIN:] = PAIRS
    return out


def features(texts: pa.Array, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the features of each text, in the order of their places, and their number before each text.

    A text shorter than a window is a feature as a whole, an empty one has none.  Runs end with
    the text, so short texts have features too.
    """
    buf = Buffer(texts, lower=False)
    n, pairs = windows(buf)
    first = np.concatenate([[0], np.cumsum(n)])
    total = int(first[-1])
    doc = np.repeat(np.arange(len(n)), n)
    # The rarest window of each run, the leftmost of equal ones, by doubling; what lies beyond a text never wins.
    order = (rank[pairs] * (total + 1) + np.arange(total)) if total else np.zeros(0, np.int64)
    low, width = order, 1
    while width < RUN and total:
        step = min(width, RUN - width)
        nxt = np.full(total, np.iinfo(np.int64).max)
        nxt[:-step] = np.where(doc[step:] == doc[:-step], low[step:], np.iinfo(np.int64).max) if step < total else nxt[:-step]
        low, width = np.minimum(low, nxt), width + step
    won = np.bincount(low % (total + 1), minlength=total) if total else np.zeros(0, np.int64)
    # Short texts have few windows, and features where a window is the rarest of a single run.
    chosen = np.flatnonzero((won >= np.clip(n // (2 * RUN), 1, NEEDED)[doc]) & (rank[pairs] < PAIRS)) if total else np.zeros(0, np.int64)
    start = buf.offsets[:-1][doc[chosen]] + chosen - first[doc[chosen]]
    code, owner = buf.hash(start, start + WINDOW), doc[chosen]
    bare = np.flatnonzero((np.diff(buf.offsets) > 1) & (np.bincount(owner, minlength=len(n)) == 0))
    code, owner = np.concatenate([code, buf.hash(buf.offsets[bare], buf.offsets[bare + 1] - 1)]), np.concatenate([owner, bare])
    # Of equal features of a text the first counts.
    by = np.lexsort((np.arange(len(code)), code, owner))
    new = np.ones(len(by), bool)
    new[1:] = (code[by][1:] != code[by][:-1]) | (owner[by][1:] != owner[by][:-1])
    kept = np.sort(by[new])
    kept = kept[np.argsort(owner[kept], kind="stable")]
    return code[kept], np.searchsorted(owner[kept], np.arange(len(n) + 1))


class Chains:
    """Bloom filters of some texts; those of text i are ``bits[first[i]:first[i + 1]]``."""

    def __init__(self, texts: pa.Array, rank: np.ndarray):
        code, start = features(texts, rank)
        count = np.diff(start)
        chain = -(-count // FEATURES)
        self.first = np.concatenate([[0], np.cumsum(chain)])
        place = np.arange(len(code)) - np.repeat(start[:-1], count)
        self.owner = np.repeat(self.first[:-1], count) + place // FEATURES
        self.held = np.bincount(self.owner, minlength=self.first[-1])
        flat = np.zeros(int(self.first[-1]) * BITS, bool)
        for k in range(HASHES):
            flat[self.owner * BITS + (code >> U(11 * k) & U(BITS - 1)).astype(np.int64)] = True
        self.bits = np.packbits(flat.reshape(-1, BITS), axis=1, bitorder="little")
        self.words = self.bits.view(np.uint64)
        self.set = np.bitwise_count(self.words).sum(axis=1).astype(np.int64)

    def text(self, i: int) -> str:
        """Fingerprint of text i: for each filter its features in hex, a colon and its bits in base 64."""
        return ".".join(f"{self.held[k]:x}:{base64.b64encode(self.bits[k].tobytes()).decode()}" for k in range(self.first[i], self.first[i + 1]))


def likeness(a: Chains, i: np.ndarray, b: Chains, j: np.ndarray) -> np.ndarray:
    """0 to 1 for texts i of ``a`` and j of ``b``: each filter's best normalised overlap, weighted by its features, both ways.

    Two texts without features are alike, one without and one with features are not.
    """
    sides = [(c, c.first[rows], np.diff(c.first)[rows]) for c, rows in ((a, i), (b, j))]
    (_, from_a, na), (_, from_b, nb) = sides
    ends = np.cumsum(na * nb)
    slots = [np.concatenate([[0], np.cumsum(count)]) for _, _, count in sides]
    best = [np.zeros(int(x[-1])) for x in slots]
    for k in range(0, int(ends[-1]) if len(ends) else 0, PAIR_BLOCK):
        flat = np.arange(k, min(k + PAIR_BLOCK, int(ends[-1])))
        pair = np.searchsorted(ends, flat, side="right")
        x, y = np.divmod(flat - (ends - na * nb)[pair], nb[pair])
        p, q = from_a[pair] + x, from_b[pair] + y
        both = np.bitwise_count(a.words[p] & b.words[q]).sum(axis=1).astype(float)
        chance, most = a.set[p] * b.set[q] / BITS, np.maximum(a.set[p], b.set[q])
        none = chance + CUTOFF * (most - chance)
        score = np.maximum(0.0, (both - none) / (most - none))
        np.maximum.at(best[0], slots[0][pair] + x, score)
        np.maximum.at(best[1], slots[1][pair] + y, score)
    out = np.where((na == 0) & (nb == 0), 1.0, 0.0)
    for (chains, start, count), top in zip(sides, best, strict=True):
        weight, owner = chains.held[ranges(start, count)], np.repeat(np.arange(len(count)), count)
        got, held = (np.bincount(owner, weights=w, minlength=len(count)) for w in (weight * top, weight))
        out += np.where((na > 0) & (nb > 0), got / np.maximum(held, 1) / 2, 0.0)
    return out


def entropy_histogram(docs: DataFrame, text: str = "text") -> np.ndarray:
    """How many windows of all texts have each number of equal byte pairs."""
    texts = pick(docs, text).select(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))

    def count(batches):
        total = np.zeros(PAIRS, np.int64)
        for batch in batches:
            for part in chunks(batch):
                total += np.bincount(windows(Buffer(part.column(0), lower=False))[1], minlength=PAIRS)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int32()), pa.array(total[hit])], names=["pairs", "n"])

    out = np.zeros(PAIRS, np.int64)
    for r in texts.mapInArrow(count, "pairs int, n bigint").groupBy("pairs").agg(F.sum("n").alias("n")).collect():
        out[r.pairs] = r.n
    return out


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document.

    The next document is that with the next smaller id, after the smallest the largest; the edited
    text has its first half, then the next document's first characters.  Null texts count as empty: their
    fingerprint is the empty string.  Documents of one id, or without one (those come last), follow each other by text, the
    larger first, and equal rows are documents of their own.  A single document is its own next.
    An empty table gives no rows.  Ids are whole numbers.
    """
    spark = docs.sparkSession
    rank = ranks(entropy_histogram(docs, text))
    rows = pick(docs, *dict.fromkeys([doc_id, text]))
    kind = rows.schema[doc_id].dataType.simpleString()
    rows = rows.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    # Ranges of ids, one after the other from the largest; a range also gets the documents that may come first in the next one.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.rdd.getNumPartitions())
    ids = rows.select(F.coalesce(F.col("doc_id").cast("double"), F.lit(float("-inf"))).alias("at"), "doc_id")
    cuts = rows.where("doc_id is not null").select(F.col("doc_id").cast("double").alias("at")).approxQuantile("at", [k / tasks for k in range(1, tasks)], 0.2 / tasks)
    splits = [float("-inf"), *(sorted(set(cuts)) or [0.0]), float("inf")]
    deal = Bucketizer(splits=splits, inputCol="at", outputCol="bin")
    turned = lambda df: deal.transform(df).withColumn("bin", (F.lit(len(splits) - 2) - F.col("bin")).cast("int"))
    heads = sorted((r.bin, r.head) for r in turned(ids).groupBy("bin").agg(F.max("doc_id").alias("head")).collect())
    follows = [(heads[k - 1][0], head) for k, (_, head) in enumerate(heads)]
    extra = spark.createDataFrame(follows, f"to_bin int, head {kind}")
    rows = turned(rows.withColumn("at", F.coalesce(F.col("doc_id").cast("double"), F.lit(float("-inf"))))).drop("at")
    copied = rows.join(F.broadcast(extra), F.col("doc_id").eqNullSafe(F.col("head")), "left")
    copied = copied.select("doc_id", "text", F.explode(F.array_compact(F.array(F.struct("bin", F.lit(False).alias("extra")), F.when(F.col("to_bin").isNotNull(), F.struct(F.col("to_bin").alias("bin"), F.lit(True).alias("extra")))))).alias("to"))
    dealt = copied.select("to.bin", "to.extra", "doc_id", "text").repartitionById(len(splits) - 1, F.col("bin"))
    dealt = dealt.sortWithinPartitions("bin", "extra", F.col("doc_id").desc_nulls_last(), F.col("text").desc())

    def run(batches):
        # The last row so far waits for the one after it.
        last = None
        for batch in batches:
            for part in chunks(batch):
                part = pa.Table.from_batches([last, part]).combine_chunks().to_batches()[0] if last is not None else part
                last = part.slice(part.num_rows - 1)
                own = np.flatnonzero(~part.column(1).to_numpy(zero_copy_only=False)[:-1])
                if len(own):
                    yield _compared(part, own, rank)

    with small_batches(spark, BATCH_ROWS):
        out = dealt.mapInArrow(run, f"doc_id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return out


def _compared(part: pa.RecordBatch, own: np.ndarray, rank: np.ndarray) -> pa.RecordBatch:
    """Result rows of the rows ``own`` of (bin, extra, doc_id, text); each is followed by its next document."""
    texts = part.column(3).to_pylist()
    edited = []
    for k in own.tolist():
        half = len(texts[k]) // 2
        edited.append(texts[k][: len(texts[k]) - half] + texts[k + 1][:half])
    as_array = pa.array(edited, pa.large_string())
    have, new = Chains(part.column(3), rank), Chains(as_array, rank)
    at = np.arange(len(own))
    fields = [
        part.column(2).take(pa.array(own)), pa.array([len(texts[k]) for k in own.tolist()], pa.int64()), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edited], pa.string()),
        pa.array([have.text(k) for k in own.tolist()], pa.string()), pa.array([new.text(k) for k in at.tolist()], pa.string()), pa.array(likeness(have, own, new, at)), pa.array(likeness(have, own, have, own + 1)),
    ]
    return pa.RecordBatch.from_arrays(fields, names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
