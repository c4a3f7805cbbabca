"""Running sums, order statistics, rolling medians, and events from bytes cut anywhere, against plain Python."""

import json
import random
import statistics

import pytest
from pyspark.sql import functions as F

from textveil.operators import running
from textveil.streaming import holdback, sse


@pytest.fixture
def measured(spark):
    """Two thirds of all rows have one key; nulls, NaN, ties and repeated rows are there."""
    draw = random.Random(3)
    keys = ["hot"] * 8 + ["a", None, "b", "c"]
    rows = [(draw.choice(keys), i // 2, i, draw.choice([None, float("nan"), 0.5, -1.0, *[draw.random() for _ in range(6)]])) for i in range(3000)]
    return rows, spark.createDataFrame(rows, "k string, t int, id int, v double").repartition(7)


def test_running_sums(measured):
    rows, df = measured
    got = {r.id: r.s for r in running.running(df, ["k"], ["t", "id"], {"s": F.col("id")}).collect()}
    sums = {}
    for k, _, i, _ in rows:
        assert got[i] == sums.get(k, 0)
        sums[k] = sums.get(k, 0) + i


def test_order_statistics(measured):
    rows, df = measured
    got = {r.k: r for r in running.order_statistics(df, ["k"], "v", {"p5": 0.05, "p95": 0.95, "p100": 1.0}).collect()}
    assert set(got) == {"hot", "a", "b", "c", None}
    for k, r in got.items():
        values = sorted(v for x, _, _, v in rows if x == k and v is not None and v == v)
        n = len(values)
        assert (r.n, r.least, r.most, r.median, r.upper_median) == (n, values[0], values[-1], statistics.median(values), values[n // 2])
        assert (r.p5, r.p95, r.p100) == tuple(values[round(f * (n - 1))] for f in (0.05, 0.95, 1.0))
    assert running.order_statistics(df.where("v is null"), ["k"], "v").collect() == []
    alone = running.order_statistics(df.where("id = 2").withColumn("v", F.lit(4.0)), [], "v").first()
    assert (alone.n, alone.median, alone.upper_median) == (1, 4.0, 4.0)


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_rolling_median(measured, keys):
    rows, df = measured
    got = {r.id: r.p50 for r in running.rolling_median(df, ["t", "id"], "v", window=20, keys=keys).collect()}
    seen = {}
    for k, _, i, v in rows:
        if v is None or v != v:
            assert i not in got
            continue
        last = seen.setdefault(k if keys else 0, [])
        last.append(v)
        assert got[i] == pytest.approx(statistics.median(last[-20:]))


STREAM = "event: a\r\ndata: {\"x\": \"ü😀\"}\r\n\r\n\n: note\ndata: one\ndata:  two three\n\ndata\ndata: [DONE]\n\nevent: last\ndata: ende".encode()
WANT = [("a", '{"x": "ü😀"}'), (None, "one\n two three"), (None, "[DONE]"), ("last", "ende")]


def test_events_of_bytes_cut_anywhere(spark):
    """Each cut in two, each width of chunks, and chunks that are null or empty give the same events."""
    cuts = {f"at{i}": [STREAM[:i], None, STREAM[i:]] for i in range(len(STREAM) + 1)}
    cuts |= {f"by{w}": [STREAM[i : i + w] for i in range(0, len(STREAM), w)] for w in (1, 2, 3, 5, 50)}
    rows = [(s, i, None if b is None else bytearray(b)) for s, bs in cuts.items() for i, b in enumerate(bs)]
    df = spark.createDataFrame(rows, "stream_id string, seq bigint, bytes binary").repartition(5)
    got = {}
    for r in sse.events(df).orderBy("stream_id", "pos").collect():
        got.setdefault(r.stream_id, []).append((r.event, r.data))
    assert set(got) == set(cuts) and all(v == WANT for v in got.values())


def test_broken_and_empty_streams(spark):
    rows = [("bad", 0, bytearray(b"data: a\xff")), ("bad", 1, bytearray(b"b\n\n")), ("none", 0, None), ("blank", 0, bytearray(b"\n\r\n\n")), (None, 0, bytearray(b"data: n"))]
    df = spark.createDataFrame(rows, "stream_id string, seq bigint, bytes binary")
    assert sorted(((r.stream_id or "", r.data) for r in sse.events(df).collect())) == [("", "n"), ("bad", "a�b")]
    assert sse.events(df.limit(0)).collect() == []


def test_events_written_and_rewritten(spark):
    cases = [("a", "x\ny"), (None, " lead"), ("b", ""), (None, None), ("c", json.dumps({"t": "ü "}, ensure_ascii=False))]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "seq bigint, event string, data string")
    back = sse.events(df.select(F.lit("s").alias("stream_id"), "seq", sse.encoded(F.col("event"), F.col("data")).alias("bytes"))).orderBy("pos").collect()
    assert [(r.event, r.data) for r in back] == [(e, d or "") for e, d in cases]
    blocks = spark.createDataFrame([("event: e\ndata: 1\nid: 7\ndata: 2",), (": only a note",)], "b string")
    assert [r[0] for r in blocks.select(sse.rewritten(F.col("b"), F.lit("{}"))).collect()] == ["event: e\ndata: {}\nid: 7", ": only a note"]
    old = spark.createDataFrame([(1, "data: a\u2028b\n\n")], "id int, raw string")
    assert holdback.sse_events(old).first().data == "a\u2028b"
