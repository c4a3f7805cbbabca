"""Mixing sources to target weights over a tree of columns, domain above language above source.

A token budget goes down the tree by weight.  A node never gets more than it can give (its tokens
times the epochs allowed), and what it can't give goes to its siblings by weight; only when a
whole family is short does an ancestor's family take the rest.  Each leaf then takes whole
epochs and, of one more, the prefix in seeded order that its budget still covers.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, sized

#: Rows of a leaf for each bin of its seeded order; only the bin in which the budget ends is sorted.
BIN_ROWS = 4000


def word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^ \t\n\r]+"), F.lit(0))).cast("bigint")


def _joined(left: DataFrame, right: DataFrame, on: Sequence[str], how: str) -> DataFrame:
    """``right``'s column given to the rows of ``left``, where nulls match nulls."""
    right = right.select(*[F.col(c).alias(f"{c}__right") for c in on], "given")
    return left.join(right, [F.col(c).eqNullSafe(F.col(f"{c}__right")) for c in on], how).drop(*[f"{c}__right" for c in on])


def tree_budgets(leaves: DataFrame, levels: Sequence[str], weights: Sequence[Mapping[str, float]], total: Column, max_epochs: int) -> DataFrame:
    """Add ``budget`` to ``leaves`` (levels, tokens): shares by weight, shortages to siblings first.

    ``weights[i]`` gives the weights of values of ``levels[i]``; what it does not name weighs 1.
    Among siblings ordered by capacity over weight, those that are filled come first, so one
    running sum finds the share of a unit of weight that the others get.
    """
    nodes = leaves.select(F.lit(0).alias("root"), *levels, (F.col("tokens") * max_epochs).alias("cap"))
    above = nodes.groupBy("root").agg(F.sum("cap").alias("all")).select("root", F.least(F.col("all").cast("double"), total.cast("double")).alias("given"))
    path = ["root"]
    for level, named in zip(levels, weights, strict=True):
        pairs = [F.lit(x) for item in sorted(named.items()) for x in item]
        weight = F.coalesce(F.create_map(*pairs)[F.col(level).cast("string")], F.lit(1.0)) if pairs else F.lit(1.0)
        kids = nodes.groupBy(*path, level).agg(F.sum("cap").cast("double").alias("cap")).withColumn("w", weight.cast("double")).where((F.col("w") > 0) & (F.col("cap") > 0))
        kids = _joined(kids, above, path, "inner")
        order = Window.partitionBy(*path).orderBy(F.col("cap") / F.col("w"), F.col(level))
        kids = kids.withColumn("filled", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        kids = kids.withColumn("unit", (F.col("given") - F.col("filled")) / F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)))
        kids = kids.withColumn("full", F.col("cap") <= F.col("w") * F.col("unit"))
        rest = F.min_by(F.when(~F.col("full"), F.col("unit")), F.when(~F.col("full"), F.col("cap") / F.col("w"))).over(Window.partitionBy(*path))
        above = kids.select(*path, level, F.when(F.col("full"), F.col("cap")).otherwise(F.col("w") * rest).alias("given"))
        path = [*path, level]
    return _joined(leaves, above, list(levels), "left").withColumn("budget", F.floor(F.coalesce(F.col("given"), F.lit(0.0)) + 1e-6).cast("bigint")).drop("given")


def mix_sources(
    docs: DataFrame, levels: Sequence[tuple[str, Column]], weights: Sequence[Mapping[str, float]], share: float = 0.6, max_epochs: int = 2, seed: int = 17, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """The rows of ``docs`` that the mixture takes, with __mix_epoch and __mix_tokens.

    The budget is ``share`` of all tokens (words between blanks).  A row appears once for each
    epoch that takes it.  Rows without a token (null or empty texts) are never taken.  A null in
    a level is a value of its own.  Order within an epoch is that of md5("seed:epoch:doc_id"),
    then of the text's digest, so repeated ids give a defined result as well.
    """
    names = [f"__mix_{n}" for n, _ in levels]
    key = F.coalesce(docs[f"`{doc_id}`"].cast("string"), F.lit(""))
    rows = docs.withColumns({f"__mix_{n}": c.cast("string") for n, c in levels} | {"__mix_tokens": word_count(docs[f"`{text}`"].cast("string")), "__mix_key": key})
    slim = rows.select(*names, "__mix_tokens").groupBy(*names).agg(F.sum("__mix_tokens").alias("tokens"), F.count("*").alias("n"))
    slim = cut(slim)
    total = slim.agg(F.floor(F.sum("tokens") * share).alias("t")).first().t or 0
    leaves = tree_budgets(slim, names, weights, F.lit(total), max_epochs).where(F.col("tokens") > 0)
    leaves = leaves.withColumn("whole", F.floor(F.col("budget") / F.col("tokens")).cast("int"))
    leaves = leaves.withColumns({"rest": F.col("budget") - F.col("whole") * F.col("tokens"), "bins": F.ceil(F.col("n") / BIN_ROWS)})
    leaves = cut(leaves.select(*[F.col(n).alias(f"{n}_") for n in names], "whole", "rest", "bins"))
    match = [F.col(n).eqNullSafe(F.col(f"{n}_")) for n in names]
    rank = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("whole").cast("string"), F.col("__mix_key")))
    bin_ = F.floor(F.conv(F.substring(rank, 1, 8), 16, 10).cast("bigint") * F.col("bins") / F.lit(float(1 << 32))).cast("bigint")
    placed = rows.where(F.col("__mix_tokens") > 0).join(sized(leaves), match).withColumn("__mix_rank", rank).withColumn("__mix_bin", bin_)
    # The bin in which each leaf's budget ends, from the sums of the bins.
    sums = placed.groupBy(*[f"{n}_" for n in names], "rest", "__mix_bin").agg(F.sum("__mix_tokens").alias("t"))
    run = Window.partitionBy(*[f"{n}_" for n in names]).orderBy("__mix_bin").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.withColumn("end", F.sum("t").over(run)).where(F.col("end") > F.col("rest"))
    last = sums.groupBy(*[F.col(f"{n}_").alias(f"{n}__") for n in names]).agg(F.min("__mix_bin").alias("last"), F.min(F.col("end") - F.col("t")).alias("before"))
    last = cut(last)
    placed = placed.join(sized(last), [F.col(f"{n}_").eqNullSafe(F.col(f"{n}__")) for n in names], "left")
    # Of the last bin, the rows whose running sum the budget covers; keys and counts only are sorted.
    ends = placed.where(F.col("__mix_bin") == F.col("last"))
    digest = F.sha2(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary"), 256)
    edge = ends.withColumn("tie", digest)
    edge = edge.select(*[f"{n}__" for n in names], "__mix_rank", "tie", "__mix_tokens", "rest", "before")
    order = Window.partitionBy(*[f"{n}__" for n in names]).orderBy("__mix_rank", "tie").rangeBetween(Window.unboundedPreceding, 0)
    edge = edge.withColumn("end", F.col("before") + F.sum("__mix_tokens").over(order)).where(F.col("end") <= F.col("rest"))
    edge = edge.groupBy(*[f"{n}__" for n in names]).agg(F.max(F.struct("__mix_rank", "tie")).alias("cut"))
    edge = cut(edge.select(*[F.col(f"{n}__").alias(f"{n}___") for n in names], "cut"))
    placed = placed.join(sized(edge), [F.col(f"{n}_").eqNullSafe(F.col(f"{n}___")) for n in names], "left")
    within = F.col("last").isNull() | (F.col("__mix_bin") < F.col("last")) | (
        (F.col("__mix_bin") == F.col("last")) & F.coalesce(F.struct(F.col("__mix_rank"), digest.alias("tie")) <= F.col("cut"), F.lit(False))
    )
    upto = F.col("whole") + F.when(within & (F.col("rest") > 0), 1).otherwise(0)
    placed = placed.withColumn("__mix_upto", upto).where(F.col("__mix_upto") > 0)
    placed = placed.withColumn("__mix_epoch", F.explode(F.sequence(F.lit(0), F.col("__mix_upto") - 1)))
    return placed.select(*[F.col(f"`{c}`") for c in docs.columns], *names, "__mix_tokens", "__mix_epoch")
