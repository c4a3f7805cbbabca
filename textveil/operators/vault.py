"""The vault: four tables that relate values to placeholders, and the joins over them."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import placeholder


def _held(df: DataFrame) -> DataFrame:
    """``df`` computed once, in the folder of ``spark.checkpoint.dir``; in local mode a folder of its own where that is unset."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="textveil-"))
    return df.checkpoint(eager=True)


def shuffled(right: DataFrame) -> DataFrame:
    """``right`` marked so that a join with it shuffles both sides, and broadcasts neither by its estimate.

    Spark's estimates pass through generators and Python as if they made one row of each, and a stored table keeps
    them: spans or events of some MB of input look slim whatever their number, and would go through the driver whole.
    """
    return right.hint("merge")


def numbered(df: DataFrame, order: list[str], name: str, first: int = 0) -> DataFrame:
    """Numbers from ``first`` in the order of the columns, without one task that sees all rows.

    Rows are dealt by ranges of the order; each range counts on from the sums of those before it,
    and only those sums, one a partition, meet.
    """
    dealt = _held(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    counts = dealt.groupBy("__part").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    within = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return dealt.withColumn("__i", within).join(F.broadcast(counts), "__part").withColumn(name, (F.col("__i") + F.col("__before") + (first - 1)).cast("bigint")).drop("__part", "__i", "__before")


def new_entities(mentions: DataFrame, entities: DataFrame | None = None) -> DataFrame:
    """Entities (type, norm, suffix_index, placeholder) that ``mentions`` (type, norm, seq, start) add.

    One counter serves all types; new values get its next numbers in the order of first mention.
    """
    first = mentions.where(F.col("norm") != "").groupBy("type", "norm").agg(F.min(F.struct("seq", "start")).alias("at"))
    base = 0
    if entities is not None:
        first = first.join(shuffled(entities.select("type", "norm")), ["type", "norm"], "left_anti")
        base = entities.agg(F.coalesce(F.max("suffix_index"), F.lit(-1)) + 1).first()[0]
    out = numbered(first.select("type", "norm", F.col("at.seq").alias("seq"), F.col("at.start").alias("start")), ["seq", "start", "type", "norm"], "suffix_index", base)
    return out.select("type", "norm", "suffix_index", placeholder.render(F.col("type"), F.col("suffix_index")).alias("placeholder"))


def restore_entries(mentions: DataFrame, entities: DataFrame, irreversible: list[str]) -> DataFrame:
    """mapping, placeholder, original, occurrences: the first spelling in a mapping is what it restores.

    Types that are irreversible leave no spelling and no entry.
    """
    keep = mentions.where(~F.col("type").isin(*irreversible)) if irreversible else mentions
    agg = keep.groupBy("mapping", "type", "norm").agg(F.min_by("surface", F.struct("seq", "start")).alias("original"), F.count("*").alias("occurrences"))
    return agg.join(shuffled(entities.select("type", "norm", "placeholder")), ["type", "norm"]).select("mapping", "placeholder", "type", "original", "occurrences")


def surface_forms(mentions: DataFrame, entities: DataFrame, irreversible: list[str], known: DataFrame | None = None) -> DataFrame:
    """placeholder, original of every spelling of reversible entities, each once; those in ``known`` are left out."""
    keep = mentions.where(~F.col("type").isin(*irreversible)) if irreversible else mentions
    forms = keep.join(shuffled(entities.select("type", "norm", "placeholder")), ["type", "norm"]).select("placeholder", F.col("surface").alias("original")).distinct()
    return forms if known is None else forms.join(known, ["placeholder", "original"], "left_anti")


def stored_values(mentions: DataFrame, irreversible: list[str]) -> DataFrame:
    """type, stored value of each entity: its key, or for irreversible types the key's SHA-256."""
    hidden = F.col("type").isin(*irreversible) if irreversible else F.lit(False)
    return mentions.select("type", F.when(hidden, F.sha2("norm", 256)).otherwise(F.col("norm")).alias("stored")).distinct()


def stats(entities: DataFrame) -> DataFrame:
    return entities.groupBy("type").agg(F.count("*").alias("n"))


def recent_mappings(mappings: DataFrame, limit: int = 20, match: str | None = None) -> DataFrame:
    """Newest first; ``match`` is a part of the source's name in any case."""
    found = mappings.where(F.col("source_name").ilike(f"%{match}%")) if match else mappings
    return found.orderBy(F.desc("created_at"), F.desc("mapping")).limit(limit)


def covering_mappings(entries: DataFrame, mappings: DataFrame, wanted: DataFrame, newest: int = 50) -> DataFrame:
    """Of the newest mappings those that issued every wanted placeholder (relational division)."""
    want = wanted.select("placeholder").distinct()
    n = want.agg(F.count("*").alias("need"))
    late = mappings.orderBy(F.desc("created_at"), F.desc("mapping")).limit(newest).select("mapping", "created_at")
    have = entries.join(late, "mapping").join(want, "placeholder").groupBy("mapping", "created_at").agg(F.count_distinct("placeholder").alias("have"))
    return have.join(n, F.col("have") == F.col("need")).select("mapping", "created_at")


def mapping_for(entries: DataFrame, mappings: DataFrame, wanted: DataFrame, newest: int = 50) -> DataFrame:
    """One row, mapping and error: the latest mapping that issued all ``wanted`` placeholders, else why there is none.

    ``error`` is "unknown" if some placeholder was issued by no mapping, "spread" if no single one has all.
    """
    covering = covering_mappings(entries, mappings, wanted, newest).agg(F.max_by("mapping", F.struct("created_at", "mapping")).alias("mapping"))
    missing = wanted.select("placeholder").distinct().join(entries.select("placeholder"), "placeholder", "left_anti").agg((F.count("*") > 0).alias("missing"))
    why = F.when(F.col("mapping").isNotNull(), F.lit(None).cast("string")).when(F.col("missing"), "unknown").otherwise("spread")
    return covering.join(missing).select("mapping", why.alias("error"))


def irreversible_placeholders(entities: DataFrame, entries: DataFrame) -> DataFrame:
    """Placeholders whose entity has no spelling: read from the vault, not from a catalogue."""
    return entities.join(entries.select("placeholder").distinct(), "placeholder", "left_anti").select("placeholder")


def outcomes(mentioned: DataFrame, entries: DataFrame, entities: DataFrame) -> DataFrame:
    """mapping, placeholder, outcome: restored, else irreversible, else foreign, else unknown."""
    asked = mentioned.select("mapping", "placeholder").distinct()
    own = entries.select(F.col("mapping").alias("__mapping"), F.col("placeholder").alias("__placeholder")).distinct().withColumn("own", F.lit(True))
    mine = F.col("mapping").eqNullSafe(F.col("__mapping")) & (F.col("placeholder") == F.col("__placeholder"))
    known = entities.select("placeholder").withColumn("known", F.lit(True))
    spelled = entries.select("placeholder").distinct().withColumn("spelled", F.lit(True))
    out = asked.join(own, mine, "left").join(shuffled(known), "placeholder", "left").join(spelled, "placeholder", "left")
    kind = F.when(F.col("own"), "restored").when(F.col("known") & F.col("spelled").isNull(), "irreversible").when(F.col("known"), "foreign").otherwise("unknown")
    return out.select("mapping", "placeholder", kind.alias("outcome"))


def adopted(mentioned: DataFrame, entities: DataFrame, entries: DataFrame, own: DataFrame | None = None) -> DataFrame:
    """Entries that a mapping takes over for placeholders already in its texts: first spelling ever stored.

    ``entries`` are all that the vault has; ``own`` those the mappings have by now (by default the same).
    Placeholders never issued, and irreversible ones, are not taken over.
    """
    first = entries.groupBy("placeholder").agg(F.min_by("original", "mapping").alias("original"))
    have = (entries if own is None else own).select(F.col("mapping").alias("__mapping"), F.col("placeholder").alias("__placeholder")).distinct()
    asked = mentioned.select("mapping", "placeholder").distinct()
    asked = asked.join(have, F.col("mapping").eqNullSafe(F.col("__mapping")) & (F.col("placeholder") == F.col("__placeholder")), "left_anti")
    return asked.join(shuffled(entities.select("placeholder", "type")), "placeholder").join(first, "placeholder").select("mapping", "placeholder", "type", "original")
