"""From candidate spans to accepted ones: thresholds, trimming, vetoes, exact cuts, greedy choice, sweep.

Everything about one document is one row: candidates are an array, so no step shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import regions, validate
from ..functions.matching import let, quoted, spans

SPANS = "array<struct<start:int,end:int,text:string,type:string,score:double,source:string,label:string>>"
#: Characters trimmed from the edges of model spans, and shortest lengths.
LEADING, TRAILING = " \t\r\n(<[{\"'„»‚‹*_", " \t\r\n.,;:!?)>]}\"'“«‘›*_"
MIN_SWEEP, MIN_REST = 3, 3
PRIORITY = {"model": 3, "regex": 2, "coref": 1}


def span(start: Column, end: Column, text: Column, kind: Column, score: Column, source: Column, label: Column) -> Column:
    parts = {"start": start.cast("int"), "end": end.cast("int"), "text": text, "type": kind, "score": score.cast("double"), "source": source, "label": label.cast("string")}
    return F.struct(*[c.alias(n) for n, c in parts.items()])


def _with(s: Column, start: Column, end: Column, text: Column) -> Column:
    return span(start, end, text, s["type"], s["score"], s["source"], s["label"])


def _cut(s: Column, doc: Column, start: Column, end: Column) -> Column:
    return _with(s, start, end, F.substring(doc, start + 1, end - start))


def above(candidates: Column, thresholds: dict[str, float], blanket: float) -> Column:
    """Candidates at or above their type's threshold, or the blanket one."""
    pairs = [F.lit(x) for t, v in sorted(thresholds.items()) for x in (t, float(v))]
    own = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,double>")
    return F.filter(candidates, lambda s: s["score"] >= F.coalesce(own[s["type"]], F.lit(float(blanket))))


def trimmed(candidates: Column, doc: Column) -> Column:
    """Model and sweep spans without blanks, brackets and stops at the edges; what is nothing then, or not where it says, is dropped."""

    def one(s: Column) -> Column:
        left = s["start"] + F.char_length(s["text"]) - F.char_length(F.ltrim(s["text"], F.lit(LEADING)))
        core = F.rtrim(F.ltrim(s["text"], F.lit(LEADING)), F.lit(TRAILING))
        return F.when(s["source"] == "regex", s).otherwise(_with(s, left, left + F.char_length(core), core))

    return F.filter(F.transform(candidates, one), lambda s: (s["text"] != "") & (F.substring(doc, s["start"] + 1, s["end"] - s["start"]) == s["text"]))


def unvetoed(candidates: Column, validators: dict[str, str]) -> Column:
    """Model spans that their type's validator accepts; rules checked theirs, sweeps follow spans that passed."""

    def fine(s: Column) -> Column:
        out = F.lit(True)
        for kind, name in sorted(validators.items()):
            out = F.when(s["type"] == kind, validate.get(name)(s["text"])).otherwise(out)
        return (s["source"] != "model") | F.coalesce(out, F.lit(False))

    return F.filter(candidates, fine)


def checked(candidates: Column, doc: Column, types: list[str]) -> Column:
    """Candidates as they are; one of a type that isn't listed, or that isn't where it says, is an error."""

    def one(s: Column) -> Column:
        at = F.concat(F.lit(" at "), s["start"].cast("string"))
        unknown = F.raise_error(F.concat(F.lit("unknown type "), F.coalesce(s["type"], F.lit("null")), at))
        misplaced = F.raise_error(F.concat(F.lit("a span isn't in its text"), at))
        here = (s["start"] >= 0) & (s["end"] > s["start"]) & (F.substring(doc, s["start"] + 1, s["end"] - s["start"]) == s["text"])
        return F.when(~F.coalesce(s["type"].isin(types), F.lit(False)), unknown.cast("boolean")).when(~F.coalesce(here, F.lit(False)), misplaced.cast("boolean")).otherwise(True)

    return F.filter(candidates, one)


def unprotected(candidates: Column, protected: Column) -> Column:
    return F.filter(candidates, lambda s: ~regions.touches(protected, s["start"], s["end"]))


def apart_from(candidates: Column, taken: Column) -> Column:
    """Candidates that overlap none of the spans ``taken``, such as placeholders already in a text."""
    return F.filter(candidates, lambda s: ~F.exists(taken, lambda o: (o["start"] < s["end"]) & (s["start"] < o["end"])))


def cut_to_exact(candidates: Column, doc: Column) -> Column:
    """Model spans that overlap rule spans keep their longest piece outside of them (the first of
    equals, three characters at least) or go."""
    exact = F.array_sort(F.filter(candidates, lambda s: s["source"] == "regex"), lambda a, b: a["start"] - b["start"])
    return let(exact, lambda e: _cut_around(candidates, doc, e))


def _cut_around(candidates: Column, doc: Column, exact: Column) -> Column:
    def outside(s: Column) -> Column:
        """The longest gap that the rule spans leave in s, as (size, -start)."""
        own = F.filter(exact, lambda e: (e["start"] < s["end"]) & (s["start"] < e["end"]))
        step = lambda acc, e: F.struct(
            F.greatest(acc["at"], e["end"]).alias("at"), F.greatest(acc["best"], F.struct((e["start"] - acc["at"]).alias("n"), (-acc["at"]).alias("back"))).alias("best")
        )
        start = F.struct(s["start"].alias("at"), F.struct(F.lit(0).alias("n"), F.lit(0).alias("back")).alias("best"))
        return F.aggregate(own, start, step, lambda acc: F.greatest(acc["best"], F.struct((s["end"] - acc["at"]).alias("n"), (-acc["at"]).alias("back"))))

    def one(s: Column) -> Column:
        hit = (s["source"] != "regex") & F.exists(exact, lambda e: (e["start"] < s["end"]) & (s["start"] < e["end"]))
        piece = lambda rest: F.when(rest["n"] >= MIN_REST, F.array(_cut(s, doc, -rest["back"], rest["n"] - rest["back"]))).otherwise(F.array().cast(SPANS))
        return F.when(hit, let(outside(s), piece)).otherwise(F.array(s))

    return F.flatten(F.transform(candidates, one))


def greedy(candidates: Column) -> Column:
    """Spans that don't overlap, chosen by length, source, score and start, sorted by start."""
    rank = lambda s: F.create_map(*[F.lit(x) for item in PRIORITY.items() for x in item])[s["source"]]
    keyed = F.transform(candidates, lambda s, i: F.struct((s["start"] - s["end"]).alias("a"), (-rank(s)).alias("b"), (-s["score"]).alias("c"), s["start"].alias("d"), i.alias("e"), s.alias("s")))
    step = lambda acc, k: F.when(F.exists(acc, lambda o: (o["start"] < k["s"]["end"]) & (k["s"]["start"] < o["end"])), acc).otherwise(F.concat(acc, F.array(k["s"])))
    return F.array_sort(F.aggregate(F.array_sort(keyed), F.array().cast(SPANS), step))


def merged(docs: DataFrame, thresholds: dict[str, float], validators: dict[str, str], blanket: float = 0.5) -> DataFrame:
    """``docs`` (text, regions, candidates) with ``candidates`` resolved: each step is a column of its own."""
    out = docs.withColumn("candidates", above(F.col("candidates"), thresholds, blanket))
    out = out.withColumn("candidates", trimmed(F.col("candidates"), F.col("text")))
    out = out.withColumn("candidates", unprotected(unvetoed(F.col("candidates"), validators), F.col("regions")))
    out = out.withColumn("candidates", cut_to_exact(F.col("candidates"), F.col("text")))
    out = out.withColumn("candidates", unvetoed(trimmed(F.col("candidates"), F.col("text")), validators))
    return out.withColumn("candidates", greedy(F.col("candidates")))


def swept(docs: DataFrame, modes: dict[str, str]) -> DataFrame:
    """``docs`` (view, candidates) with further occurrences of accepted surfaces in the masked view.

    ``modes`` by type: word and exact look between word bounds, icase in any case, off not at all.
    """
    mode = lambda s: F.create_map(*[F.lit(x) for item in sorted(modes.items()) for x in item])[s["type"]]

    def again(s: Column) -> Column:
        x = quoted(F.trim(s["text"]))
        pattern = F.when(mode(s) == "icase", F.concat(F.lit(r"(?iU)(?<![\w.+-])"), x, F.lit(r"(?![\w-])"))).otherwise(F.concat(F.lit(r"(?U)(?<!\w)"), x, F.lit(r"(?!\w)")))
        one = lambda m, i: F.get(m["found"], i)

        def build(m: Column) -> Column:
            def step(acc: Column, i: Column) -> Column:
                start = acc["at"] + F.char_length(F.get(m["gaps"], i))
                end = start + F.char_length(one(m, i))
                return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span(start, end, one(m, i), s["type"], s["score"], F.lit("coref"), F.lit(None)))).alias("out"))

            start = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("out"))
            folded = F.aggregate(F.sequence(F.lit(0), F.size(m["found"]) - 1), start, step, lambda acc: acc["out"])
            return F.when(F.size(m["found"]) > 0, folded).otherwise(F.array().cast(SPANS))

        return let(F.struct(F.regexp_extract_all(F.col("view"), pattern, F.lit(0)).alias("found"), F.split(F.col("view"), pattern, -1).alias("gaps")), build)

    wanted = F.filter("candidates", lambda s: (F.char_length(F.trim(s["text"])) >= MIN_SWEEP) & mode(s).isNotNull() & (mode(s) != "off"))
    surfaces = F.aggregate(wanted, F.array().cast(SPANS), lambda acc, s: F.when(F.exists(acc, lambda o: (o["type"] == s["type"]) & (F.lower(F.trim(o["text"])) == F.lower(F.trim(s["text"])))), acc).otherwise(F.concat(acc, F.array(s))))
    docs = docs.withColumn("__surfaces", surfaces).withColumn("__extra", F.flatten(F.transform("__surfaces", again)))
    extra = F.filter("__extra", lambda s: ~F.exists("candidates", lambda o: (o["start"] < s["end"]) & (s["start"] < o["end"])))
    return docs.withColumn("__extra", extra).withColumn("candidates", F.concat("candidates", "__extra")).drop("__surfaces", "__extra")


def resolved(docs: DataFrame, thresholds: dict[str, float], validators: dict[str, str], modes: dict[str, str], blanket: float = 0.5) -> DataFrame:
    """Merge, sweep, and merge again what the sweep added.

    A merge of what was merged changes nothing, so where the sweep added nothing the second one gets no spans to work on.
    """
    first = merged(docs, thresholds, validators, blanket).withColumn("__first", F.col("candidates"))
    added = F.size("candidates") > F.size("__first")
    out = swept(first, modes)
    out = out.withColumn("__added", added).withColumn("candidates", F.when(F.col("__added"), F.col("candidates")).otherwise(F.array().cast(SPANS)))
    out = merged(out, thresholds, validators, blanket)
    return out.withColumn("candidates", F.when(F.col("__added"), F.col("candidates")).otherwise(F.col("__first"))).drop("__first", "__added")


def rule_spans(text: Column, finders: dict[str, Column]) -> Column:
    """Spans of all rules, stamped with type; each rule's array of (start, end, text) is given."""
    stamp = lambda kind, found: F.transform(found, lambda s: span(s["start"], s["end"], s["text"], F.lit(kind), F.lit(1.0), F.lit("regex"), F.lit(None)))
    return F.concat(*[stamp(k, f) for k, f in finders.items()]) if finders else F.array().cast(SPANS)


def named_spans(text: Column, names: list[str], kind: str = "PERSON", score: float = 0.95) -> Column:
    """A model stand-in: occurrences of listed names in any case, between word bounds."""
    pattern = r"(?iU)\b(?:" + "|".join(rf"\Q{n}\E" for n in sorted(names, key=len, reverse=True)) + r")\b"
    return F.transform(spans(text, pattern), lambda s: span(s["start"], s["end"], s["text"], F.lit(kind), F.lit(score), F.lit("model"), F.lit("person")))
