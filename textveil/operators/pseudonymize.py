"""Texts to pseudonymised texts and vault rows, and back."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import finders, normalize, placeholder, regions
from ..functions.matching import let, replaced, spans
from . import merge, vault
from .catalogue import Catalogue


@dataclass
class Result:
    """Pseudonymised texts (columns of the input and ``pseudonymised``), and the vault's new rows."""

    texts: DataFrame
    mentions: DataFrame
    entities: DataFrame
    entries: DataFrame


def scan(docs: DataFrame, catalogue: Catalogue, names: list[str] | None = None, text: str = "text", scan_code: bool = False, proposed: str | None = None) -> DataFrame:
    """``docs`` with ``text`` (a null one is empty), regions, view and all ``candidates``, before any of them is judged.

    ``proposed`` names a column of spans that models or lists found in the text (``detectors.with_proposals``); one that
    isn't where it says, or of a type that the catalogue doesn't know, is an error.
    """
    out = seen(docs, text, scan_code)
    rules = {t.name: finders.get(t.backstop)(F.col("view")) for t in catalogue.enabled() if t.backstop}
    found = merge.rule_spans(F.col("view"), rules)
    if names:
        found = F.concat(found, merge.named_spans(F.col("view"), names))
    if proposed:
        given = F.coalesce(F.col(proposed), F.array().cast(merge.SPANS))
        found = F.concat(found, merge.checked(given, F.col("text"), [t.name for t in catalogue.kinds]))
    return out.withColumn("candidates", found)


def seen(docs: DataFrame, text: str = "text", scan_code: bool = False) -> DataFrame:
    """``docs`` with text, its protected regions, and the view in which they are masked."""
    value = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumn("regions", F.array().cast(regions.REGIONS) if scan_code else regions.protected_regions(value))
    return out.withColumn("view", value if scan_code else regions.masked(value, F.col("regions"))).withColumn("text", value)


def resolve(scanned: DataFrame, catalogue: Catalogue, text: str = "text") -> DataFrame:
    """``scanned`` (text, candidates) with the accepted candidates: the cheap half, to be done again with other thresholds."""
    out = scanned if {"regions", "view"} <= set(scanned.columns) else seen(scanned, text)
    return merge.resolved(out, catalogue.thresholds(), catalogue.validators(), catalogue.sweeps(), catalogue.blanket)


def detect(docs: DataFrame, catalogue: Catalogue, names: list[str] | None = None, text: str = "text", scan_code: bool = False, proposed: str | None = None) -> DataFrame:
    """``docs`` with regions, view and accepted ``candidates``; a null text counts as empty.

    Every row is scanned; ``detect_once`` scans equal texts once, and ``known.looked_up`` those that no run has met.
    """
    return resolve(scan(docs, catalogue, names, text, scan_code, proposed), catalogue)


def detect_once(docs: DataFrame, catalogue: Catalogue, names: list[str] | None = None, text: str = "text") -> DataFrame:
    """``docs`` with ``candidates``, where equal texts are scanned once: worth its shuffle where texts repeat much."""
    key, name = F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256), unused(docs, "__text_key")
    distinct = docs.select(key.alias(name), F.coalesce(F.col(text), F.lit("")).alias("text")).dropDuplicates([name])
    spans = vault._held(detect(distinct, catalogue, names).select(name, "candidates"))
    return docs.withColumn(name, key).join(spans, name).drop(name)


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` is called so."""
    while name in df.columns:
        name += "_"
    return name


#: Names a row of the texts at hand, as mappings and places may repeat or be null.
ROW = "__row"


def mentions_of(detected: DataFrame, catalogue: Catalogue) -> DataFrame:
    """One row per accepted span: mapping, seq, start, end, type, surface, norm (and ``__row``, if there)."""
    keep = [c for c in (ROW, "mapping", "seq") if c in detected.columns]
    rows = detected.select(*keep, F.inline("candidates")).withColumnRenamed("text", "surface")
    # Only surfaces that are not ASCII go to Python: they are parted by filters, since a CASE computes both of its sides.
    other = F.coalesce(F.col("surface").rlike(normalize.NOT_ASCII), F.lit(False))
    rows = rows.where(~other).withColumn("compatible", F.col("surface")).unionByName(rows.where(other).withColumn("compatible", normalize.nfkc(F.col("surface"))))
    norm = F.lit(None).cast("string")
    for t in catalogue.enabled():
        norm = F.when(F.col("type") == t.name, normalize.key_of(F.col("surface"), F.col("compatible"), t.normalizer)).otherwise(norm)
    return rows.withColumn("norm", norm).select(*keep, "start", "end", "type", "surface", "norm")


def pseudonymize(docs: DataFrame, catalogue: Catalogue, names: list[str] | None = None, entities: DataFrame | None = None, adopt: bool = False, issued: DataFrame | None = None, proposed: str | None = None) -> Result:
    """``docs``: mapping, seq (order over all texts), text.

    Every row is masked for itself, whatever repeats or is null in mapping and seq; rows of a null
    mapping share one.  ``entities``: what the vault has already; its numbers go on.  Texts that
    hold placeholders are an error, or with ``adopt`` keep them, and no span may overlap one.
    ``issued``: the entries that the vault has already; with ``adopt`` a text's mapping takes those of
    its placeholders over, so that it can restore them.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    if not adopt:
        taken = F.when(placeholder.contains(F.col("text")), F.raise_error(F.lit("a text is pseudonymised already")).cast("string"))
        text = F.coalesce(taken, text)
    more = [F.col(proposed).alias("__proposed")] if proposed else []
    found = detect(docs.select("mapping", "seq", text.alias("text"), *more), catalogue, names, proposed="__proposed" if proposed else None)
    if adopt:
        known = spans(F.col("text"), placeholder.PLACEHOLDER)
        found = found.withColumn("__issued", known).withColumn("candidates", merge.apart_from(F.col("candidates"), F.col("__issued")))
    detected = vault._held(found.select(F.monotonically_increasing_id().alias(ROW), "mapping", "seq", "text", "candidates"))
    mentions = vault._held(mentions_of(detected, catalogue).where(F.col("norm") != ""))
    new = vault.new_entities(mentions, entities)
    known = new if entities is None else entities.select(*new.columns).unionByName(new)
    known = vault._held(known)
    entries = vault.restore_entries(mentions, known, catalogue.irreversible())
    if adopt and issued is not None:
        seen = detected.select("mapping", F.explode(placeholder.found(F.col("text"))).alias("placeholder"))
        entries = entries.unionByName(vault.adopted(seen, known, issued, entries).withColumn("occurrences", F.lit(1).cast("bigint")))
    pieces = mentions.join(vault.shuffled(known), ["type", "norm"]).groupBy(ROW).agg(F.array_sort(F.collect_list(F.struct("start", "end", F.col("placeholder").alias("new")))).alias("pieces"))
    texts = detected.select(ROW, "mapping", "seq", "text").join(pieces, ROW, "left")
    none = F.array().cast("array<struct<start:int,end:int,new:string>>")
    texts = texts.withColumn("pieces", F.coalesce("pieces", none)).withColumn("pseudonymised", replaced(F.col("text"), F.col("pieces")))
    return Result(texts.select("mapping", "seq", "pseudonymised", F.size("pieces").alias("n_replaced")), mentions.drop(ROW), known, entries)


def bent(types: list[str]) -> str:
    """Pattern of what may be a bent placeholder of one of the types, with its type and code as groups.

    Brackets, quotes and blanks may stand around it, blanks or nothing for the underscores, in any case.
    """
    names = "|".join(r"[_\s]*".join(x for x in t.split("_") if x) for t in sorted(types, key=lambda t: (-len(t), t)))
    return rf"(?iU)(?<!\w)\[{{0,2}}\s*[\"']?\s*({names})[_\s]*([A-Z]+[0-9]+)\s*[\"']?\s*\]{{0,2}}(?!\w)"


def _squeezed(kind: Column, code: Column) -> Column:
    return F.concat(F.upper(F.regexp_replace(kind, r"(?U)[_\s]+", "")), F.lit("_"), F.upper(code))


def _restored_by(texts: DataFrame, entries: DataFrame, column: str, pattern: str, key: Column, row: str) -> DataFrame:
    """``column`` with the matches of ``pattern`` put back whose ``key`` (of ``found``) is that of an entry of the text's mapping.

    Matches become rows that meet the entries (mapping, key, original) by mapping and key, and go back to their row.
    """
    cut_up = F.struct(F.regexp_extract_all(F.col(column), F.lit(pattern), F.lit(0)).alias("found"), F.split(F.col(column), pattern, -1).alias("gaps"))
    rows = texts.where(F.col(column).rlike(pattern)).select(F.col(row).alias("row"), "mapping", F.posexplode(F.regexp_extract_all(F.col(column), F.lit(pattern), F.lit(0))).alias("i", "found"))
    rows = rows.withColumn("key", key)
    own = entries.select(F.col("mapping").alias("__mapping"), F.col("key").alias("__key"), "original").dropDuplicates(["__mapping", "__key"])
    hits = rows.join(vault.shuffled(own), rows["mapping"].eqNullSafe(own["__mapping"]) & (rows["key"] == own["__key"])).select("row", "i", "original")
    places = unused(texts, "__back")
    back = hits.groupBy(F.col("row").alias(row)).agg(F.map_from_entries(F.collect_list(F.struct("i", "original"))).alias(places))
    out = texts.join(back, row, "left")

    def build(m: Column) -> Column:
        n = F.size(m["found"])
        one = lambda i: F.coalesce(F.try_element_at(places, i), F.get(m["found"], i))
        return F.array_join(F.transform(F.sequence(F.lit(0), n), lambda i: F.concat(F.get(m["gaps"], i), F.when(i < n, one(i)).otherwise(F.lit("")))), "")

    return out.withColumn(column, F.when(F.col(places).isNotNull(), let(cut_up, build)).otherwise(F.col(column))).drop(places)


def reverse(texts: DataFrame, entries: DataFrame, fuzzy: bool = False, text: str = "pseudonymised", entities: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """``texts`` (mapping, ...) with ``restored``, by the entries of their own mapping only.

    ``fuzzy`` also puts back what a model bent.  With ``entities`` the placeholders that stay are
    reported once each, in order: ``irreversible``, ``foreign`` and ``unknown`` arrays; ``strict``
    then makes a foreign one an error.  Rows stay apart even if all of their columns are equal.
    """
    row = unused(texts, ROW)
    out = vault._held(texts.withColumn(row, F.monotonically_increasing_id()).withColumn("restored", F.col(text)))
    out = _restored_by(out, entries.withColumn("key", F.col("placeholder")), "restored", placeholder.PLACEHOLDER, F.col("found"), row)
    if fuzzy:
        parts = [F.regexp_extract("placeholder", placeholder.PLACEHOLDER, k) for k in (1, 2)]
        squeezed = entries.withColumn("key", _squeezed(*parts))
        # A catalogue has some dozen types.
        types = sorted(r[0] for r in entries.select(parts[0]).distinct().collect() if r[0])
        # A type that ends another one gets a pass of its own: the longer one's match may not be an entry.
        for some in (types, [t for t in types if any(o.replace("_", "").endswith(t.replace("_", "")) for o in types if o != t)]):
            if some:
                pattern = bent(some)
                out = _restored_by(out, squeezed, "restored", pattern, _squeezed(*[F.regexp_extract("found", pattern, k) for k in (1, 2)]), row)
    if entities is not None:
        out = vault._held(out)
        left = out.select(F.col(row).alias("__row"), "mapping", F.posexplode(placeholder.found(F.col("restored"))).alias("i", "placeholder"))
        judged = vault.outcomes(left, entries, entities).toDF("__mapping", "__placeholder", "outcome")
        same = F.col("mapping").eqNullSafe(F.col("__mapping")) & (F.col("placeholder") == F.col("__placeholder"))
        seen = left.join(judged, same).groupBy("__row", "placeholder", "outcome").agg(F.min("i").alias("i"))
        lists = {k: F.array_sort(F.collect_list(F.when(F.col("outcome") == k, F.struct("i", "placeholder")))) for k in ("irreversible", "foreign", "unknown")}
        seen = seen.groupBy(F.col("__row").alias(row)).agg(*[F.transform(v, lambda x: x["placeholder"]).alias(k) for k, v in lists.items()])
        out = out.join(seen, row, "left").withColumns({k: F.coalesce(k, F.array().cast("array<string>")) for k in lists})
        if strict:
            refused = F.raise_error(F.concat(F.lit("placeholders of another mapping: "), F.array_join("foreign", ", "))).cast("string")
            out = out.withColumn("restored", F.when(F.size("foreign") > 0, refused).otherwise(F.col("restored")))
    return out.drop(row)
