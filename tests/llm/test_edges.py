"""Nulls in any column, empty and very long texts, ties, repeated rows, empty tables, clashing extra columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from textveil.llm import compactwindows, covertree, importance, lshforest, mixing, outliers, packing, queries, toxicity, urlrules, warc

LONG = " ".join(f"word{i * 7919 % 10007}" for i in range(30_000))
PROSE = " ".join(f"w{i}" for i in range(80))
DOCS = [
    (None, None, None, None), (None, "no id here", "en", "src1"), (1, None, "en", "src0"), (2, "", "en", None), (3, "one", None, "src0"), (4, PROSE, "en", "src0"), (5, PROSE, "en", "src0"),
    (5, PROSE, "en", "src0"), (6, "other text with an id of two rows", "de", "src2"), (6, "second text of that id", "de", "src2"), (7, LONG, "en", "src0"), (8, "a " * 300, "en", "src0"),
]
KIND = "doc_id long, text string, lang string, source string"
#: Names that the operators use for columns of their own.
CLASH = ["node", "key", "component", "g", "l", "h", "n", "label", "labels", "tokens", "__id", "digest", "rank", "salt", "file", "at", "value", "bin", "v", "cell", "block"]


def docs_of(spark, rows):
    df = spark.createDataFrame(rows, KIND).withColumn("n_chars", F.char_length("text").cast("long"))
    return df.withColumns({c: F.lit("x") for c in CLASH})


@pytest.fixture(scope="module")
def docs(spark):
    return docs_of(spark, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return docs_of(spark, [])


@pytest.fixture(scope="module")
def marks(spark):
    rows = [(1, 1, 0), (2, None, None), (4, 1, 0), (5, 0, 1), (7, 1, 1), (None, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int").withColumns({"text": F.lit("x"), "h": F.lit("x")})


def test_importance(docs, none, marks):
    out = importance.importance_resample(docs, marks, share=0.5).collect()
    assert len(out) == len(DOCS) and sum(r.kept for r in out) == 6 and all(r.log_weight == 0 for r in out if r.doc_id in (1, 2))
    assert importance.importance_resample(none, marks).count() == 0
    assert all(r.log_weight == 0 for r in importance.importance_resample(docs, marks.where("false"), share=0.3).collect())


def test_toxicity(docs, none, marks):
    out = toxicity.toxicity(docs, marks).collect()
    assert len(out) == len(DOCS) and all(0 <= r.score <= 1 for r in out) and len({r.score for r in out if r.doc_id in (1, 2)}) == 1
    assert toxicity.toxicity(none, marks).count() == 0
    assert {r.score for r in toxicity.toxicity(docs, marks.where("false")).collect()} == {0.5}


def test_passages(docs, none):
    spans = compactwindows.repeated_passages(docs)
    rows = {(r.doc_id, r.start_word, r.end_word, r.source_id) for r in spans.collect()}
    assert (5, 0, 80, 4) in rows and {r[0] for r in rows} == {5, 7, 8}
    left = compactwindows.without_passages(docs, spans)
    assert left.columns == docs.columns and left.count() == len(DOCS) - 2
    assert all(r[c] == "x" for r in left.collect() for c in CLASH)
    assert compactwindows.repeated_passages(none).count() == 0 and compactwindows.without_passages(none, spans).count() == 0


def test_passages_of_repeated_and_missing_ids(spark):
    other = " ".join(f"v{i}" for i in range(90))
    rows = [(1, PROSE), (1, "kurz " + other), (2, "lead " + PROSE + " tail"), (None, "so " + other), (None, "x " + PROSE), (None, "x " + PROSE)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spans = compactwindows.repeated_passages(docs)
    # Of id 1 the text of the smaller digest comes first, the other one after all ids.
    assert {(r.doc_id, r.start_word, r.end_word, r.source_id) for r in spans.collect()} == {(1, 0, 80, 2), (None, 1, 91, 1), (None, 1, 81, 2)}
    left = sorted(r.text for r in compactwindows.without_passages(docs, spans).collect())
    # One text of each passage keeps it, whichever row of equal rank comes first.
    assert sum(PROSE in t for t in left) == 1 and sum(other in t for t in left) == 1 and "x " in left
    named = docs.select(F.concat(F.lit("d"), F.coalesce(F.col("doc_id").cast("string"), F.lit("?"))).alias("doc_id"), "text")
    assert compactwindows.repeated_passages(named).where("doc_id = 'd?' and source_id = 'd2'").count() == 1


def test_warc(spark):
    rows = [(None, None, None), (1, "http://a/", None), (2, None, ""), (3, "u", "z" * 150), (3, "u", "z" * 150), (4, "u", "z" * 150), (None, "u", "z" * 150), (5, "u", "y" * 3_000_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("x") for c in CLASH})
    out = warc.archive_round_trip(pages).collect()
    assert len(out) == len(rows) and [r.refers_to for r in out if r.page_id == 4] == [3] and all(r.record_type == "response" for r in out if r.page_id in (1, 2, 3, 5, None))
    assert [r.payload_bytes for r in out if r.page_id == 5] == [3_000_000]
    assert warc.archive_round_trip(pages.where("false")).count() == 0


def test_mixing(docs, none):
    def mixed(df, share, epochs=2):
        return mixing.mix_sources(df, queries.mix_levels(), queries.MIX_WEIGHTS, share, epochs, 17).select("doc_id", "text", "__mix_epoch").collect()

    assert mixed(none, 0.5) == []
    full = mixed(docs, 2.0)
    with_words = [r for r in DOCS if r[1]]
    assert len(full) == 2 * len(with_words) and {r["__mix_epoch"] for r in full} == {0, 1}
    assert mixed(docs, 0.0) == [] and all(r.text for r in full)


def test_quality(docs, none):
    out = outliers.quality_rules(docs).collect()
    assert len(out) == len(DOCS) and all(r.base_failed and not r.kept for r in out if r.n_words < 50)
    assert outliers.quality_rules(none).count() == 0


def test_embeddings(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.0]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [1.0, None]), (10, [1.0, 0.0, 0.0]), (None, [1.0, 0.01]), (11, [0.0, 1.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit("x") for c in CLASH if c != "embedding"})
    out = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in covertree.embedding_near_duplicates(vectors).collect()}
    assert out[1] == (3, 1, True) and out[2] == (3, 1, False) and out[3] == (3, 1, False) and out[None][0] == 3
    assert all(out[i] == (0, i, True) for i in (4, 5, 6, 7, 8, 9, 10, 11))
    assert covertree.embedding_near_duplicates(vectors.where("false")).count() == 0


def test_jaccard(docs, none):
    out = [(r.doc_id, r.class_id, r.n_links, r.component_id, r.kept) for r in lshforest.jaccard_join(docs).collect()]
    assert len(out) == len(DOCS) and out.count((5, 4, 2, 4, False)) == 2 and (4, 4, 2, 4, True) in out
    assert all(x[2] == 0 and x[4] for x in out if x[0] not in (4, 5))
    assert lshforest.jaccard_join(none).count() == 0


def test_packing(docs, none):
    out = packing.pack(docs, queries.tokenizer_path()).collect()
    assert sum(r.piece == 0 for r in out) == len(DOCS) and all(r.length == 1 for r in out if r.doc_id in (1, 2))
    places = {(r.sequence_id, r.offset) for r in out}
    assert len(places) == len(out) and max(r.length for r in out) == 4096
    assert packing.pack(none, queries.tokenizer_path()).count() == 0


def test_urls(spark):
    rows = [(1, None), (2, ""), (3, "no scheme"), (4, "HTTP://WWW.Example.COM/en/x?y#z"), (5, "http://a.net/es/1"), (6, "http://xnet/es/1"), (7, "http://example.com/en/q"), (8, "http://a.b.net?/fr/"), (None, "http://a.net/fr/"), (9, "x://"), (5, "http://a.net/es/1")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumns({c: F.lit("x") for c in CLASH})
    out = [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in urlrules.url_filter(pages, queries.URL_RULES).collect()]
    assert len(out) == len(rows)
    for want in [(1, "", "", None), (3, "", "", None), (4, "www.example.com", "/en/x", "www.example.com/en/"), (5, "a.net", "/es/1", "net/es/"), (6, "xnet", "/es/1", None), (7, "example.com", "/en/q", "example.com/en/"), (8, "a.b.net", "", None), (9, "", "", None)]:
        assert want in [x[:4] for x in out]
    assert {x[4] for x in out if x[3] in ("net/es/", "example.com/en/", "net/fr/")} == {"block"}
    assert urlrules.url_filter(pages.where("false"), queries.URL_RULES).count() == 0
    assert {r.verdict for r in urlrules.url_filter(pages.where("url is null or url = ''"), queries.URL_RULES).collect()} == {"allow"}


@pytest.mark.parametrize("k", range(5))
def test_stages(spark, docs, none, k):
    _, stage = corpus_pipeline.STAGES[k]
    out = stage(spark, docs, "")
    assert k == 4 or out.columns == docs.columns
    assert out.count() > 0 and stage(spark, none, "").count() == 0
    if k == 1:
        assert sum(r.doc_id == 5 for r in out.collect()) == 0 and out.where("doc_id = 6").count() == 2
