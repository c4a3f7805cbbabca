"""Gold documents: a Markdown source with marked values, JSON lines, and texts from files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.matching import spans

#: Header of a document, and a marked value in it.
HEADER, MARKER = r"(?m)^### id: ([^|\n]+?) *\| *kind: *(\S+) *$", r"\{\{([A-Z][A-Z0-9_]*):(.*?)\}\}"
SCHEMA = "id string, kind string, text string, entities array<struct<start:int,end:int,type:string,text:string>>"


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """source_name and whole text of each file."""
    return spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("source_name"), F.col("value").alias("text"))


def documents(sources: DataFrame, source: str = "source") -> DataFrame:
    """id, kind, marked text of each document; what stands before the first header is none."""
    heads = F.regexp_extract_all(source, F.lit(HEADER), F.lit(0))
    bodies = F.split(F.col(source), HEADER, -1)
    parts = F.transform(heads, lambda h, i: F.struct(F.regexp_extract(h, HEADER, 1).alias("id"), F.regexp_extract(h, HEADER, 2).alias("kind"), F.trim(F.regexp_replace(F.get(bodies, i + 1), r"^\s+|\s+$", "")).alias("marked")))
    return sources.select(F.inline(parts))


def compiled(docs: DataFrame) -> DataFrame:
    """id, kind, text without markers, entities with offsets into it."""
    marks = spans(F.col("marked"), MARKER)
    docs = docs.withColumn("m", marks).withColumn("text", F.regexp_replace("marked", MARKER, "$2"))
    shift = lambda i: F.aggregate(F.slice("m", F.lit(1), i), F.lit(0), lambda a, x: a + F.char_length(x["text"]) - F.char_length(F.regexp_extract(x["text"], MARKER, 2)))

    def one(x, i):
        value = F.regexp_extract(x["text"], MARKER, 2)
        start = x["start"] - shift(i)
        return F.struct(start.alias("start"), (start + F.char_length(value)).alias("end"), F.regexp_extract(x["text"], MARKER, 1).alias("type"), value.alias("text"))

    return docs.select("id", "kind", "text", F.transform("m", one).alias("entities"))


def entities(docs: DataFrame) -> DataFrame:
    out = compiled(docs).select("id", "kind", F.col("text").alias("t"), F.inline("entities"))
    return out.select("id", "kind", F.col("t").alias("text"), "start", "end", "type", F.col("text").alias("value"))


def write_jsonl(docs: DataFrame, path: str) -> None:
    docs.write.json(path)


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).json(path)


def problems(docs: DataFrame, types: list[str]) -> DataFrame:
    """id, problem, start of what is wrong in ``docs`` (id, text, entities): braces, offsets, type, overlap.

    ``start`` is the entity's; it is null for braces that are left in a text.
    """
    flag = lambda when, name, at: F.when(when, F.struct(F.lit(name).alias("problem"), at.alias("start")))
    ordered = F.array_sort(F.coalesce("entities", F.array().cast("array<struct<start:int,end:int,type:string,text:string>>")))

    def of(e, i):
        before = F.array_max(F.transform(F.slice("sorted", F.lit(1), i), lambda x: x["end"]))
        return F.array(
            flag(~F.substring("text", e["start"] + 1, e["end"] - e["start"]).eqNullSafe(e["text"]), "offsets", e["start"]),
            flag(~F.coalesce(e["type"].isin(types), F.lit(False)), "type", e["start"]),
            flag(before > e["start"], "overlap", e["start"]),
        )

    docs = docs.select("id", "text", ordered.alias("sorted"))
    found = F.concat(F.array(flag(F.col("text").rlike(r"\{\{|\}\}"), "braces", F.lit(None).cast("int"))), F.flatten(F.transform("sorted", of)))
    return docs.select("id", F.inline(F.filter(found, lambda x: x.isNotNull())))


def type_counts(docs: DataFrame) -> DataFrame:
    """type and n of the entities of ``docs``; the row of null type counts documents without any."""
    return docs.select(F.explode_outer("entities.type").alias("type")).groupBy("type").agg(F.count("*").alias("n"))
