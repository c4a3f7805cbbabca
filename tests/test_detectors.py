"""Names of long lists against plain Python, and a stand-in model over windows."""

import random
import re

import pytest
from pyspark.sql import functions as F

from textveil.operators import detectors
from textveil.operators.catalogue import Catalogue
from textveil.operators.pseudonymize import pseudonymize, reverse

WORDS = ["Anna", "anna", "Berg", "von", "Müller", "x1", "Straße", "e"]


@pytest.mark.parametrize("small", [detectors.SMALL_LIST, 0])
def test_listed_names(spark, monkeypatch, small):
    monkeypatch.setattr(detectors, "SMALL_LIST", small)
    draw = random.Random(11)
    phrase = lambda n: "".join(draw.choice(WORDS) + draw.choice([" ", "-", ", ", "  ", ""]) for _ in range(n))
    texts = [(i, phrase(draw.randint(0, 40))) for i in range(300)] + [(300, None), (301, ""), (302, "Anna " * 30_000)]
    names = [(phrase(draw.randint(1, 3)).strip(" ,-"), draw.choice(["PERSON", "PLACE"])) for _ in range(60)] + [(None, "PERSON"), ("", "PERSON"), (" ?Anna", "PERSON"), ("Anna", "PERSON"), ("Anna", "PERSON")]
    got = detectors.listed_spans(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(names, "name string, type string")).collect()
    want = set()
    listed = {(n.lower(), t) for n, t in names if n and re.match(r"\w", n.strip())}
    for i, text in texts[:300]:
        for m in re.finditer(r"(?<!\w)(?=\w)", text):
            fits = [(len(n), t) for n, t in listed if text[m.start() : m.start() + len(n)].lower() == n and not re.match(r"\w", text[m.start() + len(n) :])]
            want |= {(i, m.start(), m.start() + k, t) for k, t in fits if k == max(fits)[0]}
    assert {(r.doc_id, r.start, r.end, r.type) for r in got if r.doc_id < 300} == want and len(want) > 1000
    assert all(texts[r.doc_id][1][r.start : r.end] == r.text for r in got)
    kinds = {t for n, t in listed if n == "anna"}
    assert not any(n.startswith("anna anna") for n, _ in listed)
    assert sum(r.doc_id == 302 for r in got) == 30_000 * len(kinds) and len(got) == len({(r.doc_id, r.start, r.type) for r in got})
    none = detectors.listed_spans(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame([], "name string, type string"))
    assert none.collect() == []


def test_words_that_begin_no_name_stay_in_their_task(spark, monkeypatch):
    """The map of first words knows all of them and few others; odd cases of letters are found as before, by a join by shuffle."""
    monkeypatch.setattr(detectors, "SMALL_LIST", 0)
    texts = [(i, " ".join(f"w{i}x{k}" for k in range(100)) + " İzmir Straße, \u212aelvin Groß STRASSE straße") for i in range(200)]
    names = [("izmir", "A"), ("i\u0307zmir straße", "B"), ("kelvin", "C"), ("groß strasse", "D"), ("STRASSE STRAßE", "E"), ("none", "F")]
    docs, listed = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(names, "name string, type string")
    got = detectors.listed_spans(docs, listed)
    rows = got.collect()
    assert sorted(r.type for r in rows if r.doc_id == 7) == ["C", "D", "E"] or sorted(r.type for r in rows if r.doc_id == 7) == ["B", "C", "D", "E"]
    assert len(rows) == 200 * sum(r.doc_id == 7 for r in rows)
    first = spark.createDataFrame([(f"w{k}",) for k in range(1000)] + [("Straße\nx",)], "first string")
    marks = detectors._first_words(first, 1001)
    marked = lambda w: marks[(at := detectors.crc32(detectors._folded(w)) & (8 * len(marks) - 1)) >> 3] >> (at & 7) & 1
    assert all(marked(f"W{k}") for k in range(1000)) and marked("STRAßE\nX") and sum(marked(f"v{k}") for k in range(10_000)) < 400


def stand_in():
    """Finds words that begin with Q, says the wrong place for every other one, and one label that no type has."""

    def run(texts):
        assert 0 < len(texts) <= 3 and all(t.strip() for t in texts)
        return [[("person", m[0], m.start() + k % 2 * 3, 0.9) for k, m in enumerate(re.finditer(r"\bQ\w+", t))] + [("nothing", "x", None, 0.9), ("person", "not there", None, 0.9)] for t in texts]

    return run


def test_model_over_windows(spark):
    texts = [(i, " ".join((f"Q{i}n{k}" if k % 7 == 0 else f"w{k}") for k in range(i * 20))) for i in range(12)] + [(12, None), (13, " \n")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    want = sorted((i, m.start(), m[0]) for i, t in texts[:12] for m in re.finditer(r"\bQ\w+", t))
    for most, batch, parts in ((200, 3, 3), (5000, 1, 1)):
        found = detectors.model_spans(df.repartition(parts), stand_in, Catalogue(), most, batch)
        assert sorted((r.doc_id, r.start, r.text) for r in found.collect()) == want and {r.type for r in found.collect()} == {"PERSON"}
    with pytest.raises(Exception, match="answers to"):
        detectors.model_spans(df, lambda: lambda texts: [], Catalogue()).collect()


def test_proposals_in_the_flow(spark):
    docs = spark.createDataFrame([("m", 1, "Anna Berg schreibt an max@test.de, `Anna Berg` bleibt; anna berg"), ("m", 2, None), ("m", 3, "nichts")], "mapping string, seq long, text string")
    names = spark.createDataFrame([("Anna Berg", "PERSON")], "name string, type string")
    known = detectors.with_proposals(docs, detectors.listed_spans(docs, names, "seq"), "seq")
    assert known.count() == 3
    done = pseudonymize(known, Catalogue(), proposed="proposed")
    texts = {r.seq: r.pseudonymised for r in done.texts.collect()}
    assert texts[1] == "[[PERSON_A1]] schreibt an [[EMAIL_A2]], `Anna Berg` bleibt; [[PERSON_A1]]" and texts[2] == "" and texts[3] == "nichts"
    assert {r.seq: r.restored for r in reverse(done.texts, done.entries).collect()}[1] == "Anna Berg schreibt an max@test.de, `Anna Berg` bleibt; Anna Berg"
