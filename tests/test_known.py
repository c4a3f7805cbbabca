"""Candidates kept between runs: what is scanned, what is found again, and what stays of the log."""

import pytest
from pyspark.sql import functions as F

from textveil.operators import detectors, known, pseudonymize
from textveil.operators.catalogue import Catalogue

RULES = Catalogue()


def rows(df):
    return sorted(((r.id, r.known, [(s.start, s.end, s.type) for s in r.candidates]) for r in df.collect()), key=repr)


@pytest.fixture
def docs(spark):
    """A third of all rows hold one text; nulls, empty texts, repeated rows and a column with a clashing name are there."""
    texts = ["an max@test.de, max@test.de"] * 20 + ["an eva@test.de"] * 2 + [None, "", "nichts"] + [f"u{i}@test.de und 10.0.0.{i}" for i in range(30)]
    return spark.createDataFrame([(i, t, "mine") for i, t in enumerate(texts)], "id int, text string, __salt string").repartition(5)


def test_second_run_scans_nothing(spark, docs, tmp_path):
    path = str(tmp_path / "log")
    assert known.read(spark, path).collect() == []
    first = known.looked_up(docs, RULES, known.read(spark, path), 1)
    assert not any(k for _, k, _ in rows(first.docs)) and len(rows(first.docs)) == 55
    assert {r["__salt"] for r in first.docs.collect()} == {"mine"}
    known.append(first, path)
    second = known.looked_up(docs.unionByName(spark.createDataFrame([(99, "neu@test.de", "mine")], docs.schema)), RULES, known.read(spark, path), 2)
    got = rows(second.docs)
    assert [i for i, k, _ in got if not k] == [99]
    assert [(i, s) for i, _, s in got if i != 99] == [(i, s) for i, _, s in rows(first.docs)]
    # Texts that were met again leave a row without spans; a new one leaves its own.
    log = second.log.collect()
    assert sum(r.spans is not None for r in log) == 1 and len(log) == 35 and {r.used for r in log} == {2}
    known.append(second, path)
    assert known.newest(known.read(spark, path)).groupBy("used").count().collect()[0].asDict() == {"used": 2, "count": 35}


def test_resolved_as_if_scanned(spark, docs):
    """Kept candidates resolve as a scan does, at thresholds that no run asked for."""
    texts = docs.withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.lit(" von Anna Berg")))
    kept = known.looked_up(texts, RULES, None, 1, names=["Anna Berg"]).docs
    for catalogue in (RULES, RULES.overlaid({"PERSON": {"threshold": 0.99}})):
        plain = pseudonymize.detect(texts, catalogue, ["Anna Berg"])
        want = sorted((r.id, [(s.start, s.type) for s in r.candidates]) for r in plain.collect())
        assert sorted((r.id, [(s.start, s.type) for s in r.candidates]) for r in known.resolved(kept, catalogue).collect()) == want
    assert not any(t == "PERSON" for _, s in want for _, t in s)


def test_other_catalogues_and_names_are_scanned_anew(spark, docs):
    log = known.looked_up(docs, RULES, None, 1).log
    for other, names in ((RULES.overlaid({"IP": {"on": False}}), None), (RULES, ["Anna"])):
        assert not any(k for _, k, _ in rows(known.looked_up(docs, other, log, 2, names).docs))
    changed = RULES.overlaid({"CITY": {"threshold": 0.1}})
    assert all(k for _, k, _ in rows(known.looked_up(docs, changed, log, 2).docs)), "a type that is off changes nothing"
    with pytest.raises(ValueError, match="known"):
        known.looked_up(docs.withColumn("known", F.lit(1)), RULES, None, 1)
    assert known.looked_up(docs.limit(0), RULES, log, 2).docs.collect() == []


def test_rates_and_recency(spark, docs):
    some = docs.where("id < 22")
    log = known.looked_up(some, RULES, None, 1).log
    asked = known.looked_up(docs, RULES, log, 2)
    rate = known.hit_rates(asked.docs, []).first()
    assert (rate.requests, rate.asked, rate.hits, rate.hit_rate) == (55, 34, 2, 2 / 34)
    both = log.unionByName(known.looked_up(docs.where("id >= 25"), RULES, log, 2).log)
    keys = {r.text_key for r in log.collect()}
    kept = known.recent(both, 30).collect()
    assert len(kept) == 30 and not keys & {r.text_key for r in kept}
    assert len(known.recent(both, 31).collect()) == 31 and known.recent(both, 0).collect() == []


def test_proposals_are_checked(spark):
    docs = spark.createDataFrame([("m", 1, "Anna Berg")], "mapping string, seq long, text string")
    for start, kind, why in ((1, "PERSON", "isn't in its text"), (0, "NOBODY", "unknown type NOBODY")):
        spans = spark.createDataFrame([(1, start, start + 4, "Anna", kind, 0.9)], "seq long, start int, end int, text string, type string, score double")
        with pytest.raises(Exception, match=why):
            pseudonymize.detect(detectors.with_proposals(docs, spans, "seq"), RULES, proposed="proposed").collect()
