"""A corpus pipeline of five stages over ``documents``; each is written as Parquet and read by the next.

Rows are told apart by id and text digest, so a repeated id with other text is a row of its own.
Rows equal in both are one document to every decision.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textveil.llm.common import cut, free_shuffles, fresh_path, slim_join
from textveil.llm.compactwindows import repeated_passages, without_passages
from textveil.llm.lshforest import jaccard_join
from textveil.llm.mixing import mix_sources
from textveil.llm.outliers import quality_rules
from textveil.llm.packing import pack
from textveil.llm.queries import MIX_EPOCHS, MIX_SEED, MIX_WEIGHTS, mix_levels, tokenizer_path

#: Share of the tokens that the mixture of the pipeline takes.
MIX_SHARE = 0.9

def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a key of id and text digest, and that column's name, which no other column has."""
    key = "__row_key"
    while key in docs.columns:
        key += "_"
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    return docs.withColumn(key, F.struct(F.col("doc_id"), F.md5(text).alias("digest"))), key


def _without(keyed: DataFrame, judged: DataFrame, key: str) -> DataFrame:
    """The rows that ``judged`` keeps: what it rejects, the smaller part, is found once and taken out by key."""
    gone = cut(judged.where(~F.col("kept")).select(F.col("doc_id").alias(key)).distinct())
    return slim_join(keyed, gone, key, "left_anti")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    Null and empty texts have under fifty words and go; repeated rows are judged alike; an empty table stays empty.
    """
    keyed, key = _keyed(docs)
    return _without(keyed, quality_rules(keyed, doc_id=key), key).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id; of rows equal in id and text one."""
    keyed, key = _keyed(docs)
    left = _without(keyed, jaccard_join(keyed, doc_id=key), key)
    repeated = keyed.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key)
    if not repeated.isEmpty():
        again = slim_join(left, repeated, key, "left_semi").dropDuplicates([key])
        left = slim_join(left, repeated, key, "left_anti").unionByName(again)
    return left.select(*docs.columns)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that repeat earlier ones; ``n_chars`` is that of the new text."""
    out = without_passages(docs, repeated_passages(docs))
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents at the target weights; one that two epochs take is there twice.

    Null and empty texts have no token and go; an empty table stays empty.
    """
    return mix_sources(docs, mix_levels(), MIX_WEIGHTS, MIX_SHARE, MIX_EPOCHS, MIX_SEED).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences.

    A null or empty text is a piece of its end id; a document that is there twice has all of its pieces twice.
    """
    return pack(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", substrings),
    ("mixing sources", mixture),
    ("best-fit packing", packing),
]

#: SQL can't express the estimates, windows and tokens of the stages; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, f"stage-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        free_shuffles(spark)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
