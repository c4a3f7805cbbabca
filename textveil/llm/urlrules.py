"""URL filters: listed rules by host and path, and association rules mined from labelled URLs.

A URL is a basket of tokens, in which tokens of just the same labelled URLs are one item.
FP-growth finds item sets that are frequent among labelled URLs; those whose consequent is the label ``block`` with enough confidence and support become rules.
Rules match by an inverted index: each is filed under every token with the number of its tokens,
and fires on a URL that has them all.  Nothing here runs outside Spark's own operators.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, pick, sized



def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(_rest(url), r"^([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    url = F.coalesce(url, F.lit(""))
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))


def listed_verdict(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest listed rule (verdict, host, path) that fits, or nulls."""
    rule = verdict = F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def url_tokens(host: Column, path: Column, url: Column) -> Column:
    """Distinct tokens: host labels and path parts by place, query keys, scheme.

    Digits are cut from tokens, since a number names one page and no kind of page.
    """
    labels = F.reverse(F.split(host, r"\."))
    by_place = F.transform(labels, lambda x, i: F.concat(F.lit("host"), i.cast("string"), F.lit("="), x))
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    kinds = F.transform(parts, lambda x, i: F.concat(F.lit("path"), i.cast("string"), F.lit("="), F.regexp_replace(x, "[0-9]+", "")))
    query = F.filter(F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&"), lambda x: x != "")
    keys = F.transform(query, lambda x: F.concat(F.lit("key="), F.substring_index(x, "=", 1)))
    scheme = F.array(F.concat(F.lit("scheme="), F.substring_index(F.coalesce(url, F.lit("")), "://", 1)))
    return F.array_distinct(F.concat(by_place, kinds, keys, scheme))


def alike_tokens(labelled: DataFrame, min_support: float) -> DataFrame:
    """token, item of each token that at least ``min_support`` of ``labelled`` (row, tokens, blocked) have.

    Tokens of just the same rows are one item, the first of them in order, so that no token doubles
    the sets of another one that always stands beside it.  Same rows: the same number, and the same
    sum and exclusive or of two hashes of the row.  A basket has a bounded number of tokens, so mean
    basket size / ``min_support`` tokens at most are left, whatever the number of URLs.
    """
    n = labelled.count()
    tokens = labelled.select("row", F.explode(F.array_distinct("tokens")).alias("token")).groupBy("token").agg(
        F.count("*").alias("n"), F.sum(F.shiftright(F.xxhash64(F.lit(1), "row"), 24)).alias("s"), F.bit_xor(F.xxhash64(F.lit(2), "row")).alias("x")
    )
    tokens = tokens.where(F.col("n") >= F.lit(min_support) * n)
    return cut(tokens.join(tokens.groupBy("n", "s", "x").agg(F.min("token").alias("item")), ["n", "s", "x"]).select("token", "item"))


def mine_rules(labelled: DataFrame, alike: DataFrame, min_support: float = 0.01, min_confidence: float = 0.9) -> DataFrame:
    """rule_id, tokens, confidence, support: sets of items of ``labelled`` that imply ``block``.

    ``labelled``: row, tokens array<string>, blocked boolean; ``alike``: items of the frequent
    tokens.  Sets of any size are used.  A set that holds a rule fires only where that does, so items
    that are rules by themselves leave the baskets before sets are mined, and one that holds a rule of
    all its items but one is dropped.  Sets are mined from blocked rows alone; how many other rows hold
    them, which decides their confidence, is counted by their inverted index.
    """
    n = labelled.count()
    need = max(1, math.ceil(min_support * n))
    items = labelled.select("row", "blocked", F.explode("tokens").alias("token")).join(sized(alike), "token").select("row", "blocked", "item").distinct()
    items = cut(items)
    single = items.groupBy("item").agg(F.count_if("blocked").alias("hit"), F.count("*").alias("n")).where(F.col("hit") >= need)
    single = cut(single.withColumn("confidence", F.col("hit") / F.col("n")))
    sure = single.where(F.col("confidence") >= min_confidence)
    # What is left: items frequent among blocked rows that are no rule by themselves.
    open_ = items.join(sized(single.where(F.col("confidence") < min_confidence).select("item")), "item")
    baskets = cut(open_.groupBy("row", "blocked").agg(F.sort_array(F.collect_set("item")).alias("items")))
    blocked = baskets.where("blocked").select("items")
    m = blocked.count()
    rules = sure.select(F.array("item").alias("tokens"), "confidence", (F.col("hit") / F.lit(n)).alias("support"))
    if m >= need:
        found = FPGrowth(itemsCol="items", minSupport=(need - 0.5) / m).fit(blocked).freqItemsets.where(F.size("items") > 1)
        found = cut(found.select(F.array_sort("items").alias("tokens"), F.col("freq").alias("hit")).withColumn("rule_id", F.array_join("tokens", " ")))
        other = baskets.where(~F.col("blocked")).groupBy("items").agg(F.count("*").alias("times"))
        index = found.select("rule_id", F.size("tokens").alias("need"), F.explode("tokens").alias("token"))
        held = other.select("items", "times", F.explode("items").alias("token")).join(index, "token").groupBy("items", "times", "rule_id", "need").agg(F.count("*").alias("have"))
        missed = held.where(F.col("have") == F.col("need")).groupBy("rule_id").agg(F.sum("times").alias("missed"))
        found = found.join(missed, "rule_id", "left").withColumn("confidence", F.col("hit") / (F.col("hit") + F.coalesce("missed", F.lit(0))))
        rules = rules.unionByName(found.where(F.col("confidence") >= min_confidence).select("tokens", "confidence", (F.col("hit") / F.lit(n)).alias("support")))
    rules = cut(rules.withColumn("rule_id", F.array_join("tokens", " ")))
    subsets = F.when(F.size("tokens") > 2, F.transform("tokens", lambda x: F.array_except("tokens", F.array(x))))
    held = rules.select("rule_id", F.explode(F.transform(subsets, lambda x: F.array_join(x, " "))).alias("sub"))
    wider = held.join(rules.select(F.col("rule_id").alias("sub")), "sub", "left_semi").select("rule_id")
    return rules.join(wider, "rule_id", "left_anti")


def fired(baskets: DataFrame, rules: DataFrame, key: str = "tokens") -> DataFrame:
    """Distinct token sets of ``baskets`` on which a rule fires, by the rules' inverted index."""
    index = rules.select("rule_id", F.size("tokens").alias("need"), F.explode("tokens").alias("token"))
    sets = baskets.select(key).distinct()
    hits = sets.select(key, F.explode(key).alias("token")).join(index, "token").groupBy(key, "rule_id", "need").agg(F.count("*").alias("have"))
    return hits.where(F.col("have") == F.col("need")).select(key).distinct()


def url_filter(
    pages: DataFrame, rules: Sequence[tuple[str, str, str]], page_id: str = "page_id", url: str = "url", min_support: float = 0.01, min_confidence: float = 0.9
) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, method_verdict.

    URLs that a listed rule fits are the labelled ones: their verdicts are given, and FP-growth
    learns from them which tokens mean ``block``.  ``method_verdict`` is that of the mined rules
    for every URL; ``verdict`` is the listed rule's, else the method's.  A null URL, or one
    without ``://``, has an empty host and path, no rule and the verdict of its tokens.  With no
    labelled URL at all nothing is mined and the method allows.  Rows that repeat count as often
    as they occur, and each gets its row; an empty table gives no rows.
    """
    rows = pick(pages, *dict.fromkeys([page_id, url])).select(F.col(f"`{page_id}`").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"))
    rows = rows.withColumns({"host": url_host(F.col("url")), "path": url_path(F.col("url"))})
    rule, verdict = listed_verdict(F.col("host"), F.col("path"), rules)
    rows = rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("given"), url_tokens(F.col("host"), F.col("path"), F.col("url")).alias("tokens"))
    rows = cut(rows)
    labelled = rows.where(F.col("given").isNotNull()).select(F.monotonically_increasing_id().alias("row"), "tokens", (F.col("given") == "block").alias("blocked"))
    labelled = cut(labelled)
    alike = alike_tokens(labelled, min_support)
    mined = cut(mine_rules(labelled, alike, min_support, min_confidence))
    # Tokens of the items that rules use: frequent ones, so mean basket size / min_support of them at most.
    used = alike.join(mined.select(F.explode("tokens").alias("item")).distinct(), "item").orderBy("token").collect()
    name = F.create_map(*[F.lit(x) for r in used for x in (r.token, r.item)]) if used else None
    rows = rows.withColumn("basket", F.array_intersect("tokens", F.array(*[F.lit(r.token) for r in used])) if used else F.array().cast("array<string>"))
    rows = rows.withColumn("basket", F.array_sort(F.array_distinct(F.transform("basket", lambda x: name[x]))) if used else F.col("basket")).drop("tokens")
    hit = fired(rows.select(F.col("basket").alias("tokens")), mined).select(F.col("tokens").alias("basket"), F.lit("block").alias("found"))
    rows = rows.join(hit, "basket", "left").withColumn("method_verdict", F.coalesce("found", F.lit("allow")))
    return rows.select("page_id", "host", "path", "rule", F.coalesce("given", "method_verdict").alias("verdict"), "method_verdict")
