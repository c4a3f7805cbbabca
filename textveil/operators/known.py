"""Candidates kept between runs: a text is scanned once for a catalogue, and resolved anew in each run.

What is kept is a log of rows, appended to and never changed: a run appends the spans of the texts that
it scanned, and a row without spans for each text that it met again.  So two runs may append at once; where
both scanned a text, they found the same.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import merge, running
from .catalogue import Catalogue
from .pseudonymize import resolve, scan, unused
from .vault import _held

LOG = f"fingerprint string, text_key string, used bigint, spans {merge.SPANS}"
#: Texts that make up one row in this many are dealt over some tasks; there are at most as many of them.
HOT, SALTS = 256, 16


@dataclass
class Lookup:
    """``docs``: the input with ``text_key``, ``known`` (no scan was needed) and unresolved ``candidates``; ``log``: rows to append."""

    docs: DataFrame
    log: DataFrame


def scan_key(catalogue: Catalogue, names: list[str] | None = None) -> str:
    """Names what a scan looks for: the enabled types, and the listed names."""
    return hashlib.sha256(json.dumps([catalogue.fingerprint(), sorted(set(names or []))]).encode()).hexdigest()


def newest(log: DataFrame) -> DataFrame:
    """One row per fingerprint and text: when it was used last, and its spans; texts without a scan in the log have none."""
    held = log.groupBy("fingerprint", "text_key").agg(F.max("used").alias("used"), F.first("spans", ignorenulls=True).alias("spans"))
    return held.where("spans is not null")


def recent(log: DataFrame, capacity: int) -> DataFrame:
    """The ``capacity`` texts used last (of one run: by fingerprint and key), as a log to go on with."""
    back = newest(log).withColumn("__back", -F.col("used"))
    ranked = running.running(back, [], ["__back", "fingerprint", "text_key"], {"__rank": F.lit(1).cast("bigint")})
    return ranked.where(F.col("__rank") < capacity).select("fingerprint", "text_key", "used", "spans")


def looked_up(docs: DataFrame, catalogue: Catalogue, log: DataFrame | None, run: int, names: list[str] | None = None, text: str = "text") -> Lookup:
    """``docs`` with the candidates of their texts, scanned only where ``log`` has no row of them; ``run`` is this run's time or number.

    A null text counts as empty.  Equal texts are scanned once.  Columns named text_key, known or candidates are an error.
    """
    taken = {"text_key", "known", "candidates"} & set(docs.columns)
    if taken:
        raise ValueError(f"columns of these names are given back: {sorted(taken)}")
    value, mark = F.coalesce(F.col(text), F.lit("")), F.lit(scan_key(catalogue, names))
    keyed = docs.withColumn("text_key", F.sha2(value.cast("binary"), 256))
    counts = _held(keyed.groupBy("text_key").agg(F.count("*").alias("n")))
    spark = docs.sparkSession
    have = spark.createDataFrame([], LOG) if log is None else log.where(F.col("fingerprint") == mark)
    found = _held(newest(have).join(counts, "text_key", "left_semi").select("text_key", "spans"))
    # Each task sends a text once; texts that are known go no further than this join.
    missing = keyed.groupBy("text_key").agg(F.first(value).alias("text")).join(found, "text_key", "left_anti")
    fresh = _held(scan(missing, catalogue, names).select("text_key", F.col("candidates").cast(merge.SPANS).alias("spans")))
    answers = found.withColumn("known", F.lit(True)).unionByName(fresh.withColumn("known", F.lit(False)))
    log_rows = answers.select(mark.alias("fingerprint"), "text_key", F.lit(run).cast("bigint").alias("used"), F.when(~F.col("known"), F.col("spans")).alias("spans"))
    return Lookup(_met(keyed, answers.withColumnRenamed("spans", "candidates"), counts), log_rows)


def _met(keyed: DataFrame, answers: DataFrame, counts: DataFrame) -> DataFrame:
    """``keyed`` joined with the answers to its texts; texts of many rows meet copies of theirs in several tasks."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = [r[0] for r in counts.where(F.col("n") * HOT > total).select("text_key").collect()]
    salt = unused(keyed, "__salt")
    if not hot:
        return keyed.join(answers, "text_key")
    frequent = F.col("text_key").isin(hot)
    left = keyed.withColumn(salt, F.when(frequent, F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))).otherwise(F.lit(0).cast("bigint")))
    some = F.when(frequent, F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))).otherwise(F.array(F.lit(0).cast("bigint")))
    return left.join(answers.withColumn(salt, F.explode(some)), ["text_key", salt]).drop(salt)


def resolved(docs: DataFrame, catalogue: Catalogue, text: str = "text") -> DataFrame:
    """``docs`` of a lookup with their candidates resolved by the thresholds and rules of ``catalogue``; nothing is scanned.

    Equal texts are resolved once.
    """
    value = F.coalesce(F.col(text), F.lit("")).alias("text")
    once = docs.groupBy("text_key").agg(F.first(value).alias("text"), F.first("candidates").alias("candidates"), F.count("*").alias("n"))
    done = _held(resolve(once, catalogue).select("text_key", "candidates", "n"))
    return _met(docs.drop("candidates"), done.drop("n"), done.select("text_key", "n"))


def hit_rates(docs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, requests, asked and hits (different texts) and hit_rate, by ``docs`` of a lookup; each text of a key counts once."""
    once = docs.groupBy(*keys, "text_key").agg(F.count("*").alias("n"), F.first("known").cast("bigint").alias("hit"))
    out = once.groupBy(*keys).agg(F.sum("n").alias("requests"), F.count("*").alias("asked"), F.sum("hit").alias("hits"))
    return out.withColumn("hit_rate", F.col("hits") / F.col("asked"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """The log in a folder; one that is not there yet is empty."""
    try:
        return spark.read.schema(LOG).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LOG)


def append(lookup: Lookup, path: str) -> None:
    """Adds what a lookup learned to the log in a folder."""
    lookup.log.write.mode("append").partitionBy("fingerprint").parquet(path)
