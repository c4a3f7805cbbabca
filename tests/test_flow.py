"""Whole flows: masking, merging, round trips, streams, and queries against their SQL."""

import json
import time

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from textveil.functions import cipher, regions, requests
from textveil.operators import bodies, chunks, protocols, pseudonymize, vault
from textveil.operators.catalogue import Catalogue
from textveil.streaming import holdback, responses

from .oracle import same

NAMES = ["Max Mustermann", "Erika Musterfrau", "Müller-Lüdenscheidt"]
CORE = sorted(n for n in __spark_entry__.oracle_sql() if not n.startswith("op") and not n.startswith("pipeline"))


@pytest.mark.parametrize("name", CORE)
def test_query_matches_sql(spark, name):
    same(spark, __spark_entry__.queries()[name], __spark_entry__.oracle_sql()[name])


def test_round_trip_and_scope(spark):
    texts = [
        ("a", 1, "Max Mustermann (max@test.de), Tel. 0170 1234567."), ("a", 2, "Kein Wert."), ("a", 3, ""), ("a", 4, "# Max Mustermann\n- MAX MUSTERMANN\n> Müller-Lüdenscheidt 030/1234567\n"),
        ("b", 5, "`max@test.de` bleibt, <mailto:max@test.de> nicht. Karte 4111 1111 1111 1111"),
    ]
    docs = spark.createDataFrame(texts, "mapping string, seq int, text string")
    result = pseudonymize.pseudonymize(docs, Catalogue(), NAMES)
    out = {r.seq: r for r in pseudonymize.reverse(result.texts, result.entries).collect()}
    assert [out[i].pseudonymised for i in (2, 3)] == ["Kein Wert.", ""]
    assert out[1].pseudonymised.startswith("[[PERSON_A1]] ([[EMAIL_A2]]), Tel. [[PHONE_A3]].")
    assert [out[i].restored for i in (1, 2, 3)] == [t for _, i, t in texts if i < 4]
    # The first spelling of a mapping is what comes back.
    assert out[4].restored == texts[3][2].replace("MAX MUSTERMANN", "Max Mustermann")
    assert "`max@test.de`" in out[5].pseudonymised and "[[CARD_" in out[5].restored and "<mailto:max@test.de>" in out[5].restored
    foreign = pseudonymize.reverse(spark.createDataFrame([("b", "[[PERSON_A1]]")], "mapping string, pseudonymised string"), result.entries)
    assert foreign.first().restored == "[[PERSON_A1]]"


def test_null_and_repeated_places_are_masked(spark):
    texts = [(None, None, "Mail max@test.de."), ("a", None, "Von max@test.de an eva@test.de."), ("a", 1, "Nur eva@test.de"), ("a", 1, "Hier max@test.de und Müller"), (None, 2, None)]
    result = pseudonymize.pseudonymize(spark.createDataFrame(texts, "mapping string, seq int, text string"), Catalogue())
    out = result.texts.collect()
    assert sorted(r.n_replaced for r in out) == [0, 1, 1, 1, 2] and not any("@" in r.pseudonymised for r in out)
    back = pseudonymize.reverse(result.texts, result.entries).collect()
    assert sorted(r.restored for r in back) == sorted(t or "" for _, _, t in texts)


def test_outcomes_strict_and_adopted(spark):
    docs = spark.createDataFrame([("a", 1, "max@test.de, 4111 1111 1111 1111"), ("b", 2, "eva@test.de")], "mapping string, seq int, text string")
    done = pseudonymize.pseudonymize(docs, Catalogue())
    asked = spark.createDataFrame([("a", " ".join([r.placeholder for r in done.entities.orderBy("suffix_index").collect()] + ["[[PERSON_ZZ9]]", "[[PERSON_ZZ9]]"]))], "mapping string, pseudonymised string")
    row = pseudonymize.reverse(asked, done.entries, entities=done.entities).first()
    assert row.restored.startswith("max@test.de [[CARD_") and len(row.foreign) == len(row.irreversible) == len(row.unknown) == 1
    with pytest.raises(Exception, match="another mapping"):
        pseudonymize.reverse(asked, done.entries, entities=done.entities, strict=True).collect()
    more = pseudonymize.pseudonymize(spark.createDataFrame([("c", 3, "[[EMAIL_A1]] eva@test.de neu@test.de")], "mapping string, seq int, text string"), Catalogue(), entities=done.entities, adopt=True)
    known = {r.norm: r.placeholder for r in done.entities.collect()}
    text = more.texts.first().pseudonymised
    assert text.startswith("[[EMAIL_A1]] " + known["eva@test.de"]) and more.entities.count() == 4 and "neu" not in text
    wanted = lambda *p: spark.createDataFrame([(x,) for x in p], "placeholder string")
    maps = spark.createDataFrame([("a", 1), ("b", 2)], "mapping string, created_at int")
    find = lambda *p: tuple(vault.mapping_for(done.entries, maps, wanted(*p)).first())
    assert find(known["eva@test.de"]) == ("b", None) and find("[[X_A1]]") == (None, "unknown") and find(known["eva@test.de"], known["max@test.de"]) == (None, "spread")


def test_refuses_texts_with_placeholders(spark):
    docs = spark.createDataFrame([("a", 1, "x [[PERSON_A1]]")], "mapping string, seq int, text string")
    with pytest.raises(Exception, match="pseudonymised already"):
        pseudonymize.pseudonymize(docs, Catalogue())


def test_masking_keeps_length_and_lines(spark):
    text = "a\n~~~\ncode\n~~~\n<!-- x\ny --> `q` https://a.de/b [t](<c d>) ```\nend"
    view = spark.createDataFrame([(text,)], "t string").withColumn("r", regions.protected_regions(F.col("t"))).select(regions.masked(F.col("t"), F.col("r")).alias("v")).first().v
    assert len(view) == len(text) and [i for i, c in enumerate(view) if c == "\n"] == [i for i, c in enumerate(text) if c == "\n"]
    assert "code" not in view and "https" not in view and view.startswith("a\n")


def test_catalogue_checks():
    with pytest.raises(ValueError, match="claimed"):
        Catalogue().overlaid({"X": {"labels": ["email"]}})
    with pytest.raises(ValueError, match="unknown name"):
        Catalogue().overlaid({"X": {"normalizer": "none"}})
    assert "CITY" not in {k.name for k in Catalogue().enabled()} and len(Catalogue().labels()) == 31


def test_hold_back_at_every_cut():
    text = "Hallo [[PERSON_A1]] und [ref][x], [[EMAIL_B2]] [["
    for cut in range(len(text) + 1):
        a, held = holdback.feed("", text[:cut], False)
        b, rest = holdback.feed(held, text[cut:], True)
        assert a + b == text and rest == ""
        assert not any(a.endswith(p) for p in ("[[PERSON", "[[EMAIL_B2]", "[[P"))


def test_stream_with_state(spark, tmp_path):
    rows = [("s", 0, i, d, i == 4) for i, d in enumerate(["Von [[PER", "SON_A", "1]", "] an [", "x]"])]
    spark.createDataFrame(rows, "stream_id string, choice int, seq bigint, delta string, last boolean").coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("stream_id string, choice int, seq bigint, delta string, last boolean").parquet(str(tmp_path / "in"))
    out = holdback.restore_stream(source, {"[[PERSON_A1]]": "Max"})
    run = out.writeStream.format("memory").queryName("released").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    run.processAllAvailable()
    run.stop()
    assert "".join(r.released for r in spark.table("released").orderBy("seq").collect()) == "Von Max an [x]"


def test_finished_streams_are_no_groups(spark):
    """Rows of many streams are fed in one pass, cut by batches anywhere; nothing is held over into the next stream."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        pieces = ["a [[PER", "SON_A1]] b", None, " [[X", "_"]
        deltas = spark.createDataFrame([(str(s), c, k, d) for s in range(9) for c in (0, 1) for k, d in reversed(list(enumerate(pieces)))], "stream_id string, choice int, seq int, delta string")
        out = holdback.released_batch(deltas)
        assert "FlatMapGroups" not in out._jdf.queryExecution().toString()
        got = {}
        for r in out.orderBy("seq").collect():
            got.setdefault((r.stream_id, r.choice), []).append(r.released)
        assert len(got) == 18 and all(x == ["a ", "[[PERSON_A1]] b", "", " ", "[[X_"] for x in got.values())
        event = lambda i, **more: json.dumps({"type": "response.output_text.delta", "item_id": "m", "sequence_number": 7, **more})
        rows = [(s, k, event(k, delta=d)) for s in ("p", "q", None) for k, d in enumerate(["x [[A", "_B1]]", " [["])]
        out = responses.relayed_batch(spark.createDataFrame(rows, "stream_id string, seq bigint, data string"))
        assert "FlatMapGroups" not in out._jdf.queryExecution().toString()
        got = {}
        for r in out.orderBy("seq", "part").collect():
            got.setdefault(r.stream_id, []).append((r.seq, json.loads(r.data)["delta"], json.loads(r.data)["sequence_number"]))
        assert set(got) == {"p", "q", None} and all(x == [(0, "x ", 0), (1, "[[A_B1]]", 1), (2, " ", 2), (3, "[[", 3)] for x in got.values())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_chunks_take_time_in_proportion(spark):
    """A text ten times as long takes no hundred times as long: here two million characters in some seconds."""
    docs = spark.range(1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("Wörter und Zeilen 😀\n"), 100_000).alias("text"))
    began = time.monotonic()
    found = chunks.chunk_documents(docs, 512).agg(F.count("*").alias("n"), F.max(F.col("start") + F.char_length("text")).alias("end")).first()
    assert found.end == 2_000_000 and found.n > 4000 and time.monotonic() - began < 30


@pytest.mark.parametrize("most, overlap", [(7, 200), (40, 9), (1, 0)])
def test_chunks_cover_texts(spark, most, overlap):
    texts = ["", None, "kurz", "ein  langer\n\nText mit Wörtern\nund Zeilen 😀 " * 6, "x" * 95]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    found = {}
    for r in chunks.chunk_documents(docs, most, overlap).orderBy("doc_id", "chunk").collect():
        found.setdefault(r.doc_id, []).append((r.start, r.text))
    for i, text in enumerate(t or "" for t in texts):
        cuts = found[i]
        assert all(text[a : a + len(t)] == t and len(t) <= most for a, t in cuts)
        assert cuts[0][0] == 0 and cuts[-1][0] + len(cuts[-1][1]) == len(text)
        for (a, t), (b, _) in zip(cuts, cuts[1:], strict=False):
            assert a < b <= a + len(t) and a + len(t) - b <= min(overlap, most // 4)
            half = text[a + most // 2 : a + most]
            assert not any(s in half for s in ("\n\n", "\n", " ")) or t[-1] in "\n "


def test_located(spark):
    far = "Max " + "." * 200 + " Eva " + "." * 200 + " Eva"
    rows = [("a Max b", "Max", 2), ("a Max b", "Max", 5), ("a Max b", "", 2), (far, "Max", 390), (far, "Eva", 0), (far, "Eva", 210), ("a", "Max", 0), ("Max", "Max", None), ("Max", "Max", -3)]
    out = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, s string, h int").select("i", chunks.located(F.col("t"), F.col("s"), F.col("h")).alias("at")).orderBy("i").collect()
    assert [r.at for r in out] == [2, 2, None, 0, None, 205, None, 0, 0]


def texts_of(spark, protocol, *values):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, body string")
    return sorted((r.i, r.pointer, r.text) for r in bodies.text_nodes(rows, protocol).collect())


def test_answers_of_other_shapes(spark):
    odd = [None, "", "[]", "{", '{"choices": 3}', '{"choices": [null, {"message": []}]}', '{"choices": {"0": "x"}}', '{"choices": [{"message": {"content": 7}}]}']
    assert texts_of(spark, protocols.chat_answer(), *odd) == [] and texts_of(spark, protocols.responses_answer(), *odd, '{"output": [3, {"type": "message", "content": "x"}]}') == []
    body = '{"choices": [{"message": {"content": [{"type": "text", "text": "a"}, 3], "tool_calls": [{"function": {"arguments": "{no"}}]}}]}'
    assert [t for _, _, t in texts_of(spark, protocols.chat_answer(), body)] == ["a", "{no"]


def test_deep_requests_and_keys(spark):
    deep = '{"a/b": {"c~": ' + "[" * 9 + '"x", 5, true, null, ""' + "]" * 9 + "}}"
    call = {"messages": [{"role": "assistant", "content": None, "tool_calls": [{"id": "c", "type": "function", "function": {"name": "f", "arguments": deep}}]}, {"role": "user", "content": [{"type": "text", "text": "hi"}]}]}
    at = "messages/0/tool_calls/0/function/arguments/a~1b/c~0/" + "0/" * 8
    assert texts_of(spark, protocols.chat_request(), json.dumps(call)) == [(0, at + "0", "x"), (0, at + "1", "5"), (0, "messages/1/content/0/text", "hi")]
    twice = '{"messages": [], "messages": [{"content": "a"}]}'
    rows = spark.createDataFrame([(1, json.dumps(call)), (2, twice), (3, None), (4, '{"messages": [{"content": 5}], "x": ["t"]}'), (5, "[]")], "i int, body string")
    got = {r.i: (r.refused, r.pointers) for r in bodies.refusals(rows, protocols.chat_request()).collect()}
    assert got == {1: (False, []), 2: (True, [""]), 3: (True, [""]), 4: (True, ["messages/0/content", "x/0"]), 5: (True, [""])}
    only = bodies.text_nodes(spark.createDataFrame([("[]",), ('{"input": "a"}',)], "body string"), protocols.responses_request())
    assert [tuple(r) for r in only.collect()] == [("input", "a", False)]


def test_images_pass_where_allowed(spark):
    body = '{"input": [{"role": "user", "content": [{"type": "input_image", "url": "u"}, {"type": "input_text", "text": "t"}]}]}'
    assert texts_of(spark, protocols.responses_request(), body) == []
    assert texts_of(spark, protocols.responses_request(allow_images=True), body) == [(0, "input/0/content/1/text", "t")]


def test_written_back(spark):
    args = json.dumps({"a/b": 'say "x"', "n": [1.50, 7], "k": {"~": "t"}})
    body = json.dumps({"b": [{"arguments": args, "keep": [1, 2.0, None]}], "a": "é"}, ensure_ascii=False)
    root = "b/0/arguments/"
    cases = [
        (body, ["a", root + "a~1b", root + "n/0", root + "n/1", root + "k/~0"], ["ü", 'a "q" \\', "1.5", "[[PHONE_A1]]", "s"]), (None, ["a"], ["x"]), ("{no", ["a"], ["x"]), (body, [], []), (body, None, None), (body, ["c/d", "b/9/x", "a/z"], ["1", "2", "3"]),
    ]
    out = [r[0] for r in spark.createDataFrame(cases, "b string, p array<string>, t array<string>").coalesce(1).select(requests.written_back(F.col("b"), F.col("p"), F.col("t"))).collect()]
    got = json.loads(out[0])
    assert json.loads(got["b"][0]["arguments"]) == {"a/b": 'a "q" \\', "n": [1.5, "[[PHONE_A1]]"], "k": {"~": "s"}} and got["a"] == "ü" and list(got) == ["b", "a"] and got["b"][0]["keep"] == [1, 2.0, None]
    assert out[1:3] == [None, "{no"] and out[3] == out[4] == body and json.loads(out[5]) == json.loads(body)
    with pytest.raises(Exception, match="2 pointers, but 1 texts"):
        spark.createDataFrame([(body, ["a", "b"], ["x"])], "b string, p array<string>, t array<string>").select(requests.written_back(F.col("b"), F.col("p"), F.col("t"))).collect()


def test_stream_restored_by_mapping(spark, tmp_path):
    """Each stream gets its own mapping's values, by joins in each batch; a stream without one stays as it is."""
    parts = ["Von [[PER", "SON_A1]", "]!"]
    rows = [(s, 0, i, d, i == 2) for s in ("s", "t", "u") for i, d in enumerate(parts)]
    spark.createDataFrame(rows, "stream_id string, choice int, seq bigint, delta string, last boolean").coalesce(1).write.parquet(str(tmp_path / "in"))
    entries = spark.createDataFrame([("m1", "[[PERSON_A1]]", "Max"), ("m2", "[[PERSON_A1]]", "Eva")], "mapping string, placeholder string, original string")
    streams = spark.createDataFrame([("s", "m1"), ("t", "m2")], "stream_id string, mapping string")
    write = lambda df, n: df.select("stream_id", "seq", "restored").write.mode("append").parquet(str(tmp_path / "out"))
    source = spark.readStream.schema("stream_id string, choice int, seq bigint, delta string, last boolean").parquet(str(tmp_path / "in"))
    run = holdback.restore_stream(source).writeStream.foreachBatch(holdback.restoring(entries, streams, write)).option("checkpointLocation", str(tmp_path / "c")).start()
    run.processAllAvailable()
    run.stop()
    got = {}
    for r in spark.read.parquet(str(tmp_path / "out")).orderBy("seq").collect():
        got[r.stream_id] = got.get(r.stream_id, "") + r.restored
    assert got == {"s": "Von Max!", "t": "Von Eva!", "u": "Von [[PERSON_A1]]!"}
    assert holdback.feed("", "a [PERS", False, lenient=True) == ("a ", "[PERS") and holdback.feed("", "a [PERS", False) == ("a [PERS", "")


def _events(*events):
    return [json.dumps(e) if isinstance(e, dict) else e for e in events]


TEXT, CALL = {"type": "response.output_text.delta", "item_id": "m", "content_index": 0}, {"type": "response.function_call_arguments.delta", "item_id": "f"}
STREAM = _events(
    {"type": "response.created", "sequence_number": 0}, {**TEXT, "sequence_number": 1, "delta": "a [[PER"}, {**TEXT, "sequence_number": 2, "item_id": "o", "delta": "[["}, "not json",
    {**TEXT, "sequence_number": 3, "delta": "SON_A1]] b [["}, {**CALL, "sequence_number": 4, "delta": '{"x": '}, {**CALL, "delta": "1}", "sequence_number": 5}, {**TEXT, "type": "response.output_text.done", "text": "t", "sequence_number": 6},
    {**CALL, "type": "response.function_call_arguments.done", "sequence_number": 7}, {**CALL, "item_id": "g", "delta": "[1,", "sequence_number": 8}, {"type": "response.completed", "sequence_number": 9, "response": {}}, "[DONE]",
)
#: (type, delta) of what a client gets, in order.
RELAYED = [
    ("created", None), ("output_text.delta", "a "), ("output_text.delta", ""), None, ("output_text.delta", "[[PERSON_A1]] b "), ("output_text.delta", "[["), ("output_text.done", None), ("function_call_arguments.delta", '{"x": 1}'),
    ("function_call_arguments.done", None), ("output_text.delta", "[["), ("function_call_arguments.delta", "[1,"), ("completed", None), None,
]


def _read(rows):
    out, numbers = [], []
    for r in sorted(rows, key=lambda r: (r.seq, r.part)):
        event = json.loads(r.data) if r.data.startswith("{") else None
        out.append(event and (event["type"].removeprefix("response."), event.get("delta")))
        numbers += [event["sequence_number"]] if event else []
    assert numbers == list(range(len(numbers)))
    return out


def test_relayed_events_of_a_table(spark):
    rows = [(s, i, d) for s in "st" for i, d in enumerate(STREAM)] + [("cut", i, d) for i, d in enumerate(STREAM[:6])]
    got = {}
    for r in responses.relayed_batch(spark.createDataFrame(rows, "stream_id string, seq bigint, data string")).collect():
        got.setdefault(r.stream_id, []).append(r)
    assert _read(got["s"]) == _read(got["t"]) == RELAYED
    # A stream that stops gives out what it holds: texts, then the call as far as it came.
    assert _read(got["cut"]) == [*RELAYED[:5], ("output_text.delta", "[["), ("output_text.delta", "[["), ("function_call_arguments.delta", '{"x": ')]


def test_relayed_events_over_triggers_and_timer(spark, tmp_path):
    """One event a trigger, streams side by side; one stops, and its timer releases what is held."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = "stream_id string, seq bigint, data string"
    steps = [(0, 4), (4, 8), (8, 12)]
    try:
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in*"))
        for k, (a, b) in enumerate(steps):
            rows = [(s, i, STREAM[i]) for s in ("s", "cut") for i in range(a, min(b, 6) if s == "cut" else b)]
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in{k}"))
        write = lambda df, n: df.write.mode("append").parquet(str(tmp_path / "out"))
        run = responses.relayed_stream(source, idle_ms=3_000).writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="1 second").start()
        got = {}
        for _ in range(60):
            time.sleep(1)
            assert run.exception() is None
            if (tmp_path / "out").exists():
                rows = spark.read.schema("stream_id string, seq bigint, part int, data string").parquet(str(tmp_path / "out")).collect()
                got = {s: [r for r in rows if r.stream_id == s] for s in ("s", "cut")}
                if len(got["s"]) >= len(RELAYED) and len(got["cut"]) >= 8:
                    break
        run.stop()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert _read(got["s"]) == RELAYED
    assert _read(got["cut"]) == [*RELAYED[:5], ("output_text.delta", "[["), ("output_text.delta", "[["), ("function_call_arguments.delta", '{"x": ')]


def test_restored_bodies_keep_json_valid(spark):
    call = json.dumps({"to": "[[PERSON_A1]]", "n": 5})
    body = {"output": [{"type": "message", "content": [{"type": "output_text", "text": "An [[PERSON_A1]]"}]}, {"type": "function_call", "arguments": call}, {"type": "function_call", "arguments": '{"to": [[PERSON_A1]]'}]}
    rows = [("m", json.dumps(body)), ("n", json.dumps(body)), ("m", None), ("m", "[[PERSON_A1]]"), ("m", '{"output": []}')]
    entries = spark.createDataFrame([("m", "[[PERSON_A1]]", 'Max "M" \\')], "mapping string, placeholder string, original string")
    out = [(r.mapping, r.body) for r in bodies.restored_bodies(spark.createDataFrame(rows, "mapping string, body string"), protocols.responses_answer(), entries).collect()]
    assert sorted(x for x in out if x[1] is not None and not x[1].startswith('{"output": [{')) == [("m", "[[PERSON_A1]]"), ("m", '{"output": []}')] and ("m", None) in out and ("n", rows[1][1]) in out
    got = json.loads(next(b for m, b in out if m == "m" and b and "Max" in b))["output"]
    assert got[0]["content"][0]["text"] == 'An Max "M" \\' and json.loads(got[1]["arguments"]) == {"to": 'Max "M" \\', "n": 5} and got[2]["arguments"] == '{"to": Max "M" \\'


def test_cipher(spark):
    rows = spark.createDataFrame([(1, "Max", "a"), (2, "", "a"), (3, None, "a"), (4, "Max", None)], "i int, v string, b string")
    stored = rows.withColumn("e", cipher.encrypted(F.col("v"), "k", F.col("b"))).checkpoint()
    out = stored.select("i", "v", "e", cipher.decrypted(F.col("e"), "k", F.col("b")).alias("d"), cipher.decrypted(F.col("e"), "other", F.col("b")).alias("o"), cipher.decrypted(F.col("e"), "k", F.lit("c")).alias("c")).collect()
    assert all(r.d == r.v and r.o is None and r.c is None for r in out) and len({r.e for r in out}) == 4
    digest = lambda k, n, s: rows.limit(1).select(cipher.lookup(F.lit(k), F.lit(n), s)).first()[0]
    assert digest("A", "b", "k") == digest("A", "b", "k") and len({digest("A", "b", "k"), digest("A", "b", "l"), digest("B", "b", "k"), digest("A", "c", "k")}) == 4
    with pytest.raises(ValueError, match="secret"):
        cipher.encrypted(F.col("v"), "")
