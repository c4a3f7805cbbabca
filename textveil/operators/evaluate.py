"""Scores of predicted spans against gold spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.matching import let

#: Fixed value: the label of predictions that no model label stands behind.
BY_RULE = "(rule)"
#: The quality that a configuration must reach to be chosen for its speed.
MIN_RECALL, MIN_PRECISION = 0.90, 0.85


def matches(gold: DataFrame, predicted: DataFrame, exact: bool = False) -> DataFrame:
    """doc_id, type, gold and found (sorted spans, with their labels if there are any), and which of each are matched: hit and used (positions).

    ``gold`` and ``predicted``: doc_id, type, start, end, and a label of predictions if they have one.
    Per document and type each gold span in turn takes the unmatched prediction with the largest
    overlap (the first of equals), or the one with just its bounds.
    """

    both = _sides(gold, predicted)
    return both.withColumn("m", _matched("gold", "found", exact)).select("doc_id", "type", "gold", "found", "m.used", "m.hit")


def _sides(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """doc_id, type, gold and found: sorted spans, gathered from both tables by one shuffle.  Rows of a null document or type meet none of the other table."""
    span = "struct<start:int,end:int,label:string,score:double>"

    def side(df, n):
        own = [F.col(c) if c in df.columns else F.lit(None) for c in ("label", "score")]
        one = F.struct("start", "end", *[c.alias(k) for c, k in zip(own, ("label", "score"), strict=True)]).cast(span)
        return df.select("doc_id", "type", F.lit(n).alias("side"), one.alias("s"), F.when(F.col("doc_id").isNull() | F.col("type").isNull(), n).alias("apart"))

    lists = [F.array_sort(F.collect_list(F.when(F.col("side") == n, F.col("s")))).alias(name) for n, name in enumerate(("gold", "found"))]
    return side(gold, 0).unionByName(side(predicted, 1)).groupBy("doc_id", "type", "apart").agg(*lists).drop("apart")


def _matched(gold: str, found: str, exact: bool = False) -> Column:
    """Of two columns of sorted spans the positions that are matched: hit of ``gold``, used of ``found``."""

    def step(state, i):
        g = F.get(gold, i)
        overlap = lambda p: F.least(g["end"], p["end"]) - F.greatest(g["start"], p["start"])
        fits = lambda p: (p["start"] == g["start"]) & (p["end"] == g["end"]) if exact else overlap(p) > 0
        rated = F.transform(found, lambda p, k: F.struct(overlap(p).alias("n"), (-k).alias("back"), fits(p).alias("ok")))
        open_ = F.filter(rated, lambda x: x["ok"] & ~F.array_contains(state["used"], -x["back"]))
        taken = lambda best: F.struct(F.array_append(state["used"], -best["back"]).alias("used"), F.array_append(state["hit"], i).alias("hit"))
        return let(F.array_max(open_), lambda best: F.when(best.isNotNull(), taken(best)).otherwise(state))

    nothing = F.struct(F.array().cast("array<int>").alias("used"), F.array().cast("array<int>").alias("hit"))
    return F.aggregate(F.transform(gold, lambda _, i: i), nothing, step)


def counts(gold: DataFrame, predicted: DataFrame, exact: bool = False) -> DataFrame:
    """type, tp, fp, fn over all documents."""
    both = matches(gold, predicted, exact).withColumn("tp", F.size("used"))
    return both.groupBy("type").agg(F.sum("tp").alias("tp"), F.sum(F.size("found") - F.col("tp")).alias("fp"), F.sum(F.size("gold") - F.col("tp")).alias("fn"))


def label_counts(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """label, tp, fp, precision of predictions by overlap; gold spans have no label, so there is no recall."""
    found = matches(gold, predicted).select("used", F.posexplode("found").alias("k", "p"))
    ok = F.array_contains("used", F.col("k")).cast("bigint")
    label = F.coalesce(F.nullif(F.col("p.label"), F.lit("")), F.lit(BY_RULE)).alias("label")
    out = found.groupBy(label).agg(F.sum(ok).alias("tp"), F.sum(1 - ok).alias("fp"))
    return out.withColumn("precision", F.col("tp") / (F.col("tp") + F.col("fp")))


def mistakes(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """kind ("fp" or "fn"), doc_id, type, start, end of each span that nothing matches."""

    def left(kind, spans, taken):
        rest = F.filter(spans, lambda _, k: ~F.array_contains(taken, k))
        return F.transform(rest, lambda p: F.struct(F.lit(kind).alias("kind"), p["start"].alias("start"), p["end"].alias("end")))

    both = F.inline(F.concat(left("fp", "found", "used"), left("fn", "gold", "hit")))
    return matches(gold, predicted).select("doc_id", "type", both).select("kind", "doc_id", "type", "start", "end")


def first_mistakes(found: DataFrame, limit: int = 15) -> DataFrame:
    """The first ``limit`` mistakes of each kind by document and place, numbered ``n``, and how many ``more`` there are."""
    total = found.groupBy("kind").agg(F.count("*").alias("all"))
    n = F.row_number().over(Window.partitionBy("kind").orderBy("doc_id", "start", "end", "type"))
    first = found.withColumn("n", n).where(F.col("n") <= limit)
    return first.join(F.broadcast(total), "kind").withColumn("more", F.greatest(F.col("all") - limit, F.lit(0))).drop("all")


def verdicts(scored: DataFrame, bars: DataFrame) -> DataFrame:
    """type, ok, reason for each of ``bars`` (type, min_recall, min_precision; null: not asked for).

    A type without a bar has no row.  One without gold spans is ok, with the reason that nothing was measured.
    """
    both = bars.where("min_recall IS NOT NULL OR min_precision IS NOT NULL").join(scored.select("type", "support", "recall", "precision"), "type", "left")
    under = [F.when(F.col(m) < F.col(f"min_{m}"), F.format_string(f"{m} %.3f under %.3f", m, F.col(f"min_{m}").cast("double"))) for m in ("recall", "precision")]
    measured = F.coalesce(F.col("support"), F.lit(0)) > 0
    why = F.concat_ws(" and ", *under)
    return both.select("type", (~measured | (why == "")).alias("ok"), F.when(~measured, "nothing measured").when(why == "", "meets bar").otherwise(why).alias("reason"))


def gated(measured: DataFrame, min_recall: float = MIN_RECALL, min_precision: float = MIN_PRECISION) -> DataFrame:
    """``measured`` (p50, recall, precision, error or none; a row per configuration) with ``status`` and ``best``.

    ``status`` is ``error``, ``ok`` or ``below``: quality that isn't measured is below, one at the bar is ok.
    ``best`` is true for the least p50 of those that are ok, all of them if they tie; a null p50 is never the best.
    """
    failed = F.col("error").isNotNull() if "error" in measured.columns else F.lit(False)
    fine = F.coalesce((F.col("recall") >= min_recall) & (F.col("precision") >= min_precision), F.lit(False))
    out = measured.withColumn("status", F.when(failed, "error").when(fine, "ok").otherwise("below"))
    least = out.where("status = 'ok' and not isnan(p50)").agg(F.min("p50").alias("__least"))
    # The other side is one row.
    met = out.crossJoin(F.broadcast(least))
    return met.withColumn("best", F.coalesce((F.col("status") == "ok") & (F.col("p50") == F.col("__least")), F.lit(False))).drop("__least")


def report(scored: DataFrame) -> DataFrame:
    """at, line: a Markdown table of ``scored`` (type, tp, fp, fn, precision, recall, f1), most false positives first, then by type."""
    figure = lambda c: F.format_string("%.3f", F.col(c).cast("double"))
    cells = F.concat_ws(" | ", F.coalesce("type", F.lit("")), *[F.col(c).cast("string") for c in ("tp", "fp", "fn")], *[figure(c) for c in ("precision", "recall", "f1")])
    # A row per type: some dozen.
    n = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("fp"), "type"))
    head = ["| type | tp | fp | fn | precision | recall | f1 |", "|---|---|---|---|---|---|---|"]
    top = scored.sparkSession.createDataFrame(list(enumerate(head)), "at int, line string")
    return top.unionByName(scored.select((n + 1).alias("at"), F.concat(F.lit("| "), cells, F.lit(" |")).alias("line")))


def scores(counted: DataFrame) -> DataFrame:
    """Adds precision, recall, f1, support; an empty denominator counts as 1, and F1 of nothing as 0."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    p, r = F.coalesce(tp / F.nullif(tp + fp, F.lit(0)), F.lit(1.0)), F.coalesce(tp / F.nullif(tp + fn, F.lit(0)), F.lit(1.0))
    out = counted.withColumns({"precision": p, "recall": r, "support": tp + fn})
    return out.withColumn("f1", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0))


def threshold_sweep(gold: DataFrame, candidates: DataFrame, thresholds: list[float]) -> DataFrame:
    """Counts at each threshold: spans and candidates (doc_id, type, start, end, score) meet once, and are matched anew for each."""
    step = F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold")
    kept = F.filter("found", lambda p: p["score"] >= F.col("threshold")).alias("found")
    both = _sides(gold, candidates).select("type", "gold", "found", step).select("type", "threshold", "gold", kept).where(F.size("gold") + F.size("found") > 0)
    out = both.select("type", "threshold", F.size("gold").alias("g"), F.size("found").alias("p"), F.size(_matched("gold", "found")["used"]).alias("tp"))
    return out.groupBy("type", "threshold").agg(F.sum("tp").alias("tp"), F.sum(F.col("p") - F.col("tp")).alias("fp"), F.sum(F.col("g") - F.col("tp")).alias("fn"))
