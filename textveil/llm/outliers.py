"""Quality rules: base statistics of each text, then robust multivariate outliers.

A minimum-covariance-determinant (MCD) estimate is made for every language and source from all
texts that pass the base rules, by concentration steps (C-steps) that Spark runs as one grouped
aggregation each.  Texts are rejected by Mahalanobis distance from that estimate.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_size, cut, pick, row_count, sized, stored
from .hashing import NONBLANK, U, Buffer, Words, chunks, mix

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: The characters that count as symbols.
SYMBOLS = "#*$%&|<>"
_IS_SYMBOL = np.array([chr(b) in SYMBOLS for b in range(256)])
_NOT_FEED = np.arange(256) != 10


def _repeated(hashes: np.ndarray, group: np.ndarray) -> np.ndarray:
    """True where the hash occurs twice or more in its group."""
    key = mix(hashes ^ mix(group.astype(U), 3))
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    same = ranked[1:] == ranked[:-1]
    out = np.zeros(len(key), dtype=bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def text_statistics(texts: pa.Array) -> dict[str, np.ndarray]:
    """The five base statistics of each text; null counts as empty."""
    words = Words(texts, NONBLANK, lower=False)
    buf: Buffer = words.buffer
    n, size = words.count(), len(buf)
    lead = np.concatenate([[0], np.cumsum((buf.bytes & 0xC0) != 0x80)])
    chars = np.concatenate([[0], np.cumsum(lead[words.end] - lead[words.start])])
    symbols = np.concatenate([[0], np.cumsum(_IS_SYMBOL[buf.bytes])])
    # Lines: what stands between line feeds, if it has a word.
    start, end = buf.runs(_NOT_FEED)
    holds = np.searchsorted(words.start, end) > np.searchsorted(words.start, start)
    start, end = start[holds], end[holds]
    doc = np.searchsorted(buf.offsets, start, side="right") - 1
    key = mix(buf.hash(start, end) ^ mix(doc.astype(U), 5))
    order = np.argsort(key, kind="stable")
    again = order[1:][key[order][1:] == key[order][:-1]]
    # Windows of three words.
    tri, first = words.shingles(3, whole=False)
    owner = np.repeat(np.arange(size), np.diff(first))
    twice = _repeated(tri, owner) if len(tri) else np.zeros(0, bool)
    at = np.arange(len(tri)) - np.repeat(first[:-1], np.diff(first)) + np.repeat(words.first[:-1], np.diff(first))
    covered = np.zeros(len(words.hash) + 2, dtype=bool)
    for k in range(3):
        covered[at[twice] + k] = True
    covering = np.concatenate([[0], np.cumsum(covered[: len(words.hash)])])
    return {
        "n_words": n,
        "word_chars": chars[words.first[1:]] - chars[words.first[:-1]],
        "n_symbols": symbols[buf.offsets[1:]] - symbols[buf.offsets[:-1]],
        "n_dup_lines": np.bincount(doc[again], minlength=size),
        "n_repeat_words": covering[words.first[1:]] - covering[words.first[:-1]],
    }


def with_statistics(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Columns ``keep`` of ``df`` and the five statistics of its texts."""
    source = df.select(*[df[f"`{c}`"].alias(f"k{i}") for i, c in enumerate(keep)], df[f"`{text}`"].cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            for part in chunks(batch):
                found = text_statistics(part.column(len(keep)))
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(i) for i in range(len(keep))], *[pa.array(found[s], pa.int64()) for s in STATS]],
                    names=[*[f"k{i}" for i in range(len(keep))], *STATS],
                )

    kinds = ", ".join(f"k{i} {source.schema[f'k{i}'].dataType.simpleString()}" for i in range(len(keep)))
    out = source.mapInArrow(run, ", ".join(x for x in (kinds, *[f"{s} bigint" for s in STATS]) if x))
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *STATS)


#: Resolution of each transformed statistic: its square is added to the variance, as in the regularized estimate (MRCD),
#: so that a statistic which is the same in nearly all texts of a group doesn't make the group's rule infinitely strict.
#: f0: 8 % of a mean word length.  f1 to f3: 0.35 is about half of what the first repeated line adds (log 2).
RESOLUTION = {"f0": 0.08, "f1": 0.35, "f2": 0.35, "f3": 0.35}
FEATURES = list(RESOLUTION)
#: Seeded starts besides that of medians, rows of such a start, steps before only the best start goes on, and steps at most.
STARTS, START_ROWS, FIRST_STEPS, STEPS = 3, 10, 2, 20
#: Share of the rows that reweighting keeps, if they are normal.
CORE = 0.975


def chi2_tail(x: float, p: int) -> float:
    """P(chi-square of p degrees > x), p even."""
    return math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(p // 2))


def chi2_quantile(share: float, p: int) -> float:
    low, high = 0.0, 2000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - chi2_tail(mid, p) < share else (low, mid)
    return low


def consistency(share: float, p: int) -> float:
    """By what the covariance of the nearest ``share`` of normal rows has to be multiplied."""
    return share / (1 - chi2_tail(chi2_quantile(share, p), p + 2))


def transformed() -> dict[str, F.Column]:
    """The vector: log mean word length, log counts of symbols, repeated lines and repeated words, each on its own scale."""
    n = F.col("n_words").cast("double")
    return {
        "f0": F.log((F.col("word_chars") + 1.0) / (n + 1.0)),
        "f1": F.log1p(100.0 * F.col("n_symbols") / (F.col("word_chars") + 1.0)),
        "f2": F.log1p(F.col("n_dup_lines").cast("double")),
        "f3": F.log1p(10.0 * F.col("n_repeat_words") / (n + 1.0)),
    }


def fitted(n: float, sums: np.ndarray, products: np.ndarray, factor: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Centre, inverse of the regularized covariance and log of its determinant, from sums and products (upper triangle)."""
    p = len(FEATURES)
    mean, cov = sums / n, np.zeros((p, p))
    cov[np.triu_indices(p)] = products / n
    cov = factor * (cov + np.triu(cov, 1).T - np.outer(mean, mean)) + np.diag([RESOLUTION[f] ** 2 for f in FEATURES])
    values, vectors = np.linalg.eigh(cov)
    # Rounding may take a little off the least ones.
    values = np.maximum(values, 1e-6)
    return mean, (vectors / values) @ vectors.T, float(np.log(values).sum())


def _estimate(factor: float):
    @F.pandas_udf("center array<double>, precision array<double>, logdet double")
    def run(n: pd.Series, sums: pd.Series, products: pd.Series) -> pd.DataFrame:
        found = [fitted(k, np.asarray(s), np.asarray(q), factor) for k, s, q in zip(n, sums, products, strict=True)]
        return pd.DataFrame([(c.round(9).tolist(), v.round(9).ravel().tolist(), round(d, 9)) for c, v, d in found], columns=["center", "precision", "logdet"])

    return run


_PAIRS = [(i, j) for i in range(len(FEATURES)) for j in range(i, len(FEATURES))]


def _moments(weight: F.Column | None = None) -> list[F.Column]:
    """Count, sums and products of rows; weighted, of bins that have them already."""
    if weight is None:
        own = [F.count("*"), *[F.sum(f) for f in FEATURES], *[F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])) for i, j in _PAIRS]]
        return [x.cast("double").alias(f"m{k}") for k, x in enumerate(own)]
    total = [F.sum(F.col(f"m{k}") * weight) for k in range(1 + len(FEATURES) + len(_PAIRS))]
    cut_ = 1 + len(FEATURES)
    return [total[0].alias("n"), F.array(*total[1:cut_]).alias("sums"), F.array(*total[cut_:]).alias("products")]


def _distance() -> F.Column:
    p = len(FEATURES)
    diff = [F.col(f) - F.col("center")[i] for i, f in enumerate(FEATURES)]
    return sum((diff[i] * diff[j] * F.col("precision")[i * p + j] for i in range(p) for j in range(p)), F.lit(0.0))


def _median_start(rows: DataFrame, group: str) -> DataFrame:
    """Medians, and deviations from them, from counts on a fine grid: a few thousand cells a group and statistic."""
    grid = 64.0
    cells = cut(
        rows.select(group, F.posexplode(F.array(*FEATURES)).alias("f", "x"))
        .groupBy(group, "f", F.round(F.col("x") * grid).cast("int").alias("cell"))
        .agg(F.count("*").alias("n"))
    )

    def middle(df: DataFrame, value: str, name: str) -> DataFrame:
        order = Window.partitionBy(group, "f").orderBy(value)
        run = df.withColumn("c", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        run = run.withColumn("all", F.sum("n").over(Window.partitionBy(group, "f")))
        return run.where(F.col("c") * 2 >= F.col("all")).groupBy(group, "f").agg(F.min(value).alias(name))

    med = middle(cells, "cell", "m")
    off = cells.join(sized(med), [group, "f"]).select(group, "f", "n", F.abs(F.col("cell") - F.col("m")).alias("o")).groupBy(group, "f", "o").agg(F.sum("n").alias("n"))
    least = F.create_map(*[F.lit(x) for i, f in enumerate(FEATURES) for x in (i, RESOLUTION[f])])
    both = middle(off, "o", "s").join(med, [group, "f"]).withColumns({"m": F.col("m") / grid, "s": F.sqrt(F.pow(F.col("s") / grid * 1.4826, 2) + F.pow(least[F.col("f")], 2))})
    start = both.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("f", "m", "s"))).alias("x"))
    p = len(FEATURES)
    precision = F.array(*[F.pow(F.get("x", F.lit(i))["s"], -2) if i == j else F.lit(0.0) for i in range(p) for j in range(p)])
    return start.select(group, F.lit(0).alias("start"), F.col("x.m").alias("center"), precision.alias("precision"), F.lit(float("inf")).alias("logdet"))


def mcd(rows: DataFrame, group: str, h_share: float = 0.75, seed: int = 3) -> DataFrame:
    """Centre, precision and logdet of each group of ``rows`` (group, f0 to f3): reweighted MCD over all rows.

    Starts are the medians and ``STARTS`` seeded draws of some ``START_ROWS`` rows.  After a few
    concentration steps from each, the one of the smallest determinant goes on until no group's
    determinant falls any more; the rows that then lie within the ``CORE`` quantile give the
    estimate.  A step is one aggregation: distances are binned on a log grid, and a group's bins
    (320 at most) are summed from the nearest on, the last one in part, until they hold
    ``h_share`` of its rows; so no step sorts or gathers a group.
    """
    p = len(FEATURES)
    bins = F.greatest(F.lit(-96), F.least(F.lit(223), F.floor(F.log2(F.col("d2") + 1e-12) * 16))).cast("int")
    factor = consistency(h_share, p)

    def summed(df: DataFrame, *keys: str) -> DataFrame:
        """Moments by key: summed where the rows lie, then by all keys, before whatever needs fewer of them together."""
        return df.groupBy(*keys).agg(*_moments()).repartition(*keys[:2])

    def step(state: DataFrame) -> DataFrame:
        near = rows.join(slim(state.drop("logdet")), group).withColumn("d2", _distance()).withColumn("bin", bins)
        sums = summed(near, group, "start", "bin")
        order = Window.partitionBy(group, "start")
        sums = sums.withColumn("before", F.coalesce(F.sum("m0").over(order.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        sums = sums.withColumn("h", F.ceil(F.sum("m0").over(order) * h_share)).where(F.col("before") < F.col("h"))
        subset = sums.groupBy(group, "start").agg(*_moments(F.least(F.lit(1.0), (F.col("h") - F.col("before")) / F.col("m0"))))
        return cut(subset.select(group, "start", _estimate(factor)("n", "sums", "products").alias("e")).select(group, "start", "e.*"))

    counts = cut(rows.groupBy(group).agg(F.count("*").alias("all")))
    # A state has a row for each group and start at most.
    slim = by_size(row_count(counts) * (STARTS + 1))
    draws = rows.join(slim(counts), group).withColumn("start", F.explode(F.sequence(F.lit(1), F.lit(STARTS))))
    draws = draws.where(F.pmod(F.xxhash64(F.lit(seed), "start", *FEATURES), F.greatest(F.lit(1), F.floor(F.col("all") / START_ROWS))) == 0)
    drawn = draws.groupBy(group, "start").agg(*_moments()).groupBy(group, "start").agg(*_moments(F.lit(1.0)))
    drawn = drawn.select(group, "start", _estimate(1.0)("n", "sums", "products").alias("e")).select(group, "start", "e.*")
    state = cut(_median_start(rows, group).unionByName(drawn))
    for _ in range(FIRST_STEPS):
        state = step(state)
    # The smallest determinant; of equal ones the first start.
    best = F.min_by(F.struct("center", "precision", "logdet"), F.struct("logdet", "start")).alias("e")
    state = cut(state.groupBy(group).agg(best).select(group, F.lit(0).alias("start"), "e.*"))
    for _ in range(STEPS - FIRST_STEPS):
        after = step(state)
        falls = after.join(state.select(group, F.col("logdet").alias("was")), group).where(F.col("logdet") < F.col("was") - 1e-3)
        # Where a step (that takes the last bin in part) no longer helps, the state before it stays.
        state, going = cut(after.unionByName(state).groupBy(group).agg(best).select(group, F.lit(0).alias("start"), "e.*")), not falls.isEmpty()
        if not going:
            break
    core = rows.join(slim(state), group).where(_distance() <= chi2_quantile(CORE, p)).groupBy(group).agg(*_moments()).groupBy(group).agg(*_moments(F.lit(1.0)))
    return cut(core.select(group, _estimate(consistency(CORE, p))("n", "sums", "products").alias("e")).select(group, "e.*"))


def quality_rules(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", min_group: int = 40, h_share: float = 0.75, alpha: float = 1e-5
) -> DataFrame:
    """One row per document: doc_id, the five statistics, base_failed, distance, kept.

    ``base_failed``: under 50 words, or over half of them in repeated three-word windows.  The
    others get the squared Mahalanobis distance from the MCD estimate of their language and
    source and are kept up to the chi-square quantile that a share ``alpha`` of normal vectors
    exceeds.  Groups of fewer than ``min_group`` such texts share
    one estimate per language, and what is still too small one for all; if that is too small as
    well, its texts are kept with a null distance.  Null texts count as empty, null languages
    and sources as a value of their own; repeated ids are judged row by row.
    """
    ids = pick(docs, *dict.fromkeys([doc_id, lang, source, text]))
    stats = with_statistics(ids, [doc_id, lang, source], text)
    stats = stats.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.to_json(F.struct(F.col(f"`{lang}`").cast("string"))), F.lit("")).alias("l"), F.coalesce(F.to_json(F.struct(F.col(f"`{source}`").cast("string"))), F.lit("")).alias("o"), *STATS)
    stats = stats.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    stats = stored(stats, "quality-stats")
    passed = stats.where(~F.col("base_failed"))
    counts = passed.groupBy("l", "o").agg(F.count("*").alias("n"))
    small = F.col("n") < min_group
    counts = counts.withColumn("rest", F.sum(F.when(small, F.col("n")).otherwise(0)).over(Window.partitionBy("l")))
    counts = counts.withColumn("g", F.when(~small, F.concat_ws("\u0001", "l", "o")).when(F.col("rest") >= min_group, F.concat_ws("\u0001", "l", F.lit("*"))).otherwise(F.lit("*")))
    groups = cut(counts.select("l", "o", "g"))
    rows = passed.withColumns(transformed()).join(sized(groups), ["l", "o"])
    rows = stored(rows.select("g", *FEATURES), "quality-vectors")
    state = mcd(rows, "g", h_share)
    cutoff = chi2_quantile(1 - alpha, len(FEATURES))
    enough = counts.groupBy("g").agg(F.sum("n").alias("n")).where(F.col("n") >= min_group).select("g")
    params = cut(groups.join(state, "g").join(enough, "g", "left_semi").select("l", "o", "center", "precision"))
    judged = stats.withColumns(transformed()).join(sized(params), ["l", "o"], "left")
    judged = judged.withColumn("distance", F.when(~F.col("base_failed"), _distance()))
    return judged.select("doc_id", *STATS, "base_failed", "distance", (~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= cutoff)).alias("kept"))
