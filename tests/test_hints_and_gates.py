"""Hints on placeholders in request bodies, gates of speed and quality, and reports."""

import json

import pytest
from pyspark.sql import functions as F

from textveil.functions.requests import HINT, with_hint
from textveil.operators import bodies, evaluate


def test_hints(spark):
    cases = ['{"model": "m", "messages": [{"role": "user", "content": "ü"}], "n": 1}', '{"messages": "x"}', '{"other": []}', "[1]", "no json", None, '{"messages": []}']
    df = spark.createDataFrame([(i, b, n) for i, b in enumerate(cases) for n in (0, 2, None)], "id int, body string, n_replaced int")
    got = {(r.id, r.n_replaced): r.body for r in bodies.hinted(df, "messages").collect()}
    told = {"role": "system", "content": HINT}
    assert json.loads(got[0, 2]) == {"model": "m", "messages": [told, {"role": "user", "content": "ü"}], "n": 1} and list(json.loads(got[0, 2])) == ["model", "messages", "n"]
    assert json.loads(got[6, 2]) == {"messages": [told]}
    assert all(got[i, n] == b for i, b in enumerate(cases) for n in (0, 2, None) if n != 2 or i not in (0, 6)) and len(got) == 21


def test_hints_of_the_other_protocol(spark):
    entry = lambda role, x: {"type": "message", "role": role, "content": x}
    cases = {'{"input": "a"}': [entry("user", "a")], '{"input": null}': [], '{"input": [{"type": "item"}]}': [{"type": "item"}]}
    df = spark.createDataFrame([(b,) for b in cases], "body string")
    for r in df.select("body", with_hint(F.col("body"), "input", "message").alias("new")).collect():
        assert json.loads(r.new)["input"] == [entry("system", HINT), *cases[r.body]]


@pytest.mark.parametrize("failed", [True, False])
def test_gates(spark, failed):
    rows = [("a", 5.0, 0.90, 0.85, None), ("b", 1.0, 0.89, 0.99, None), ("c", 5.0, 1.0, 1.0, None), ("d", 0.5, 1.0, 1.0, "no memory"), ("e", None, 1.0, 1.0, None), ("f", 0.1, None, 1.0, None), ("g", float("nan"), 1.0, 1.0, None)]
    df = spark.createDataFrame(rows, "name string, p50 double, recall double, precision double, error string")
    df = df if failed else df.drop("error")
    got = {r.name: (r.status, r.best) for r in evaluate.gated(df).collect()}
    assert got == {"a": ("ok", failed), "b": ("below", False), "c": ("ok", failed), "d": ("error", False) if failed else ("ok", True), "e": ("ok", False), "f": ("below", False), "g": ("ok", False)}
    assert not any(r.best for r in evaluate.gated(df.where("name = 'b'")).collect()) and evaluate.gated(df.limit(0)).collect() == []


def test_report(spark):
    df = spark.createDataFrame([("B", 1, 0, 1), ("A", 3, 0, 0), ("C", 0, 4, 0)], "type string, tp long, fp long, fn long")
    lines = [r.line for r in evaluate.report(evaluate.scores(df)).orderBy("at").collect()]
    assert lines[2:] == ["| C | 0 | 4 | 0 | 0.000 | 1.000 | 0.000 |", "| A | 3 | 0 | 0 | 1.000 | 1.000 | 1.000 |", "| B | 1 | 0 | 1 | 1.000 | 0.500 | 0.667 |"]
    assert len(evaluate.report(evaluate.scores(df.limit(0))).collect()) == 2
