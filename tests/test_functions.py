"""Fixed vectors of the scalar functions; each function runs once over all of its vectors."""

import json
import random

import pytest
from pyspark.sql import functions as F

from textveil.functions import finders, normalize, phones, placeholder, requests, validate
from textveil.operators import bodies, protocols

VALID = {
    "iban_mod97": (["DE89 3704 0044 0532 0130 00"], ["DE90370400440532013000", "DE8937040044053201300", "DE8937040044053201300²", "DE893Ä0400440532013000"]),
    "luhn": (["4111111111111111", "4111 1111 1111 1111"], ["4111111111111112", "18"]),
    "tax_de": (["36574261809", "181/815/08155", "1337108153", "13/371/08153", "36574261808", "DE123456789", "DE 123 456 789"], ["123456789", "1234567890123", "DE12345678", "DE1234567890", "FR123456789"]),
    "bank_routing_de": (["37040044", "DEUTDEFF", "DEUTDEFF500", "deutdeff"], ["3704004", "DEUTDEF", "DEUTDEFF50", "1EUTDEFF", "DEUT12FF"]),
    "postal_de": (["50667"], ["5066"]),
    "ip_parse": (["192.168.0.1", "2001:db8::1", "::1"], ["999.1.1.1", "1.2.3"]),
    "expiry_shape": (["03/28", "03/2028"], ["13/28", "März"]),
    "cvv_shape": (["123", "1234"], ["12", "12a"]),
    "email_syntax": (["max@test.de"], ["Systemmail"]),
    "phone_shape": (["+49 170 1234567", "+49 (0) 151 4433221", "030/1234567"], ["2024", "+49 170 1234567 123456", "+999 1234567", "Tel 12"]),
    "phone_valid": (["+49 170 1234567", "0170/1234567", "01511 2345678", "0049 30 123456", "+43 664 1234567", "+1 (212) 555-0100", "+39 06 1234567"], ["+49 (0) 151 4433221", "2024", "12.03.2026", "+1 123 4567890", "+33 0612345678", "+210 1234567", "+", ""]),
}
KEYS = {
    "phone": {"+49 170 1234567": "+491701234567", "+49 (0) 170 1234567": "+491701234567", "0170/1234567": "+491701234567", "Aktenzeichen 2024": "2024", "Durchwahl 12": "12", "Rechnung 4711": "4711", "0151 4433221": "01514433221", "49 170 1234567": "+491701234567", "keine": "keine"},
    "email": {"Max@Test.DE": "max@test.de", "  max@test.de  ": "max@test.de"},
    "person": {"Dr. Max Mustermann": "max mustermann", "Herrn Dr. Max Mustermann": "max mustermann", "Max  Mustermann": "max mustermann", "Max von Bergen": "max von bergen", "Weiß": "weiss", "Dr. Prof.": "dr. prof."},
    "strip_upper": {"DE89 3704 0044 0532 0130 00": "DE89370400440532013000"},
    "digits": {"4111 1111-1111 1111": "4111111111111111", "CVV: 123": "123"},
    "casefold": {"  Musterstraße   5 ": "musterstrasse 5", "ﬁn": "fin"},
    "identity": {"  Sk-Live-XYZ ": "  Sk-Live-XYZ "},
    "date_iso": {"12.03.2026": "2026-03-12", "2026-03-12": "2026-03-12", "12. Maerz 2026": "12. maerz 2026"},
    "expiry": {"08/27": "08/27", "08-27": "08/27", "08 / 27": "08/27", "08/2027": "08/27", "not a date": "not a date"},
}
FOUND = {
    "email": ("Mail max@test.de. Oder Max.Mustermann@firma-gmbh.de, m.mustermann+news@sub.domain.co.uk", ["max@test.de", "Max.Mustermann@firma-gmbh.de", "m.mustermann+news@sub.domain.co.uk"]),
    "iban": ("IBAN DE89 3704 0044 0532 0130 00 BIC COBADEFFXXX", ["DE89 3704 0044 0532 0130 00"]),
    "card": ("Karte 4111 1111 1111 1111 12/25 und 4111111111111112", ["4111 1111 1111 1111"]),
    "ip": ("von 192.168.0.1 an 2001:db8::1 nicht 999.1.1.1", ["192.168.0.1", "2001:db8::1"]),
    "vat_de": ("USt DE123456789, nicht DE1234567890", ["DE123456789"]),
    "phone": ("Tel. 0170 1234567, +49 30 123456, am 12.03.2026, RE 2024-00123, 0151 4433221 ist zu kurz", ["0170 1234567", "+49 30 123456"]),
}


@pytest.mark.parametrize("name", VALID)
def test_validator(spark, name):
    good, bad = VALID[name]
    rows = spark.createDataFrame([(x, True) for x in good] + [(x, False) for x in bad], "x string, want boolean")
    assert [r.x for r in rows.where(validate.get(name)(F.col("x")) != F.col("want")).collect()] == []


@pytest.mark.parametrize("name", KEYS)
def test_normalizer(spark, name):
    rows = spark.createDataFrame(list(KEYS[name].items()), "x string, want string")
    assert {r.x: r.got for r in rows.select("x", normalize.normalize(F.col("x"), name).alias("got")).collect()} == KEYS[name]


@pytest.mark.parametrize("name", FOUND)
def test_finder(spark, name):
    text, want = FOUND[name]
    got = spark.createDataFrame([(text,)], "t string").select(finders.get(name)(F.col("t")).alias("f")).first().f
    assert [s.text for s in got] == want
    assert all(text[s.start : s.end] == s.text for s in got)


def test_numbering_plan_against_longest_prefix(spark):
    """Random digits: the pattern agrees with a search of the longest prefix, for plans of countries and of areas."""
    draw = random.Random(5)
    starts = sorted(phones.areas())
    numbers = ["".join(draw.choice("0123456789") for _ in range(draw.randint(1, 16))) for _ in range(2000)]
    numbers += [draw.choice(starts) + "".join(draw.choice("0123456789") for _ in range(draw.randint(0, 13))) for _ in range(9000)]

    def fits(plan, number):
        prefix = next((number[:k] for k in range(len(number), 0, -1) if number[:k] in plan), None)
        return prefix is not None and plan[prefix][0] <= len(number) - len(prefix) <= plan[prefix][1]

    rows = spark.createDataFrame([(n, fits(phones.areas(), n), fits(phones.countries(), n)) for n in numbers], "n string, valid boolean, possible boolean")
    full = F.concat(F.lit("+"), F.col("n"))
    assert rows.where(full.rlike(phones.VALID) != F.col("valid")).collect() == [] == rows.where(full.rlike(phones.POSSIBLE) != F.col("possible")).collect()
    assert rows.where("valid").count() > 1000 and rows.where("possible and not valid").count() > 100
    at = spark.createDataFrame([("0664 1234567", "AT"), ("(212) 555-0100", "US"), ("1 212 555 0100", "US"), ("06 1234567", "IT"), (None, "DE"), ("x" * 100_000, "DE")], "x string, region string")
    got = {r.x and r.x[:14]: r for r in at.select("x", *[phones.e164(F.col("x"), k).alias(k) for k in ("DE", "AT", "US", "IT")]).collect()}
    assert got["0664 1234567"].AT == "+436641234567" and got["(212) 555-0100"].US == got["1 212 555 0100"].US == "+12125550100" and got["06 1234567"].IT == "+39061234567"
    assert got[None].DE is None and got["x" * 14].DE is None


def test_file_numbers_are_no_telephone_numbers(spark):
    """Digits of the right length after a word need a trunk prefix or country code; on their own they don't."""
    want = {"Aktenzeichen 234567": "234567", "Aktenzeichen 491701234567": "491701234567", "Tel. 0170 1234567": "+491701234567", "Tel. +49 170 1234567": "+491701234567", "170 1234567": "+491701234567"}
    rows = spark.createDataFrame([(x,) for x in want], "x string")
    assert {r.x: r.got for r in rows.select("x", normalize.normalize(F.col("x"), "phone").alias("got")).collect()} == want


def test_request_texts_and_refusals(spark):
    call = {"id": "c", "type": "function", "function": {"name": "send", "arguments": json.dumps({"to/x": "Max", "n": 5})}}
    cases = [
        ([{"role": "user", "content": "[[PERSON_A1]] wrote"}], {"messages/0/content": "[[PERSON_A1]] wrote"}),
        ([{"role": "user", "content": [{"type": "text", "text": "a"}]}], {"messages/0/content/0/text": "a"}),
        ([{"role": "assistant", "content": None, "tool_calls": [call]}], {"messages/0/tool_calls/0/function/arguments/to~1x": "Max", "messages/0/tool_calls/0/function/arguments/n": "5"}),
        ([{"role": "user", "content": [{"type": "image_url", "image_url": {"url": "u"}}]}], None),
        ([{"role": "user", "content": "a", "tool_calls": [{"function": {"arguments": "{"}}]}], None),
    ]
    asked = [(i, json.dumps({"model": "m", "messages": m}), w) for i, (m, w) in enumerate(cases)] + [(8, '{"input": "Max"}', None), (9, '{"instructions": "Max", "messages": []}', None)]
    df = spark.createDataFrame([b[:2] for b in asked], "id int, body string")
    rows, refused = bodies.text_nodes(df, protocols.chat_request()).collect(), {r.id: r.refused for r in bodies.refusals(df, protocols.chat_request()).collect()}
    for i, _, want in asked:
        assert refused[i] == (want is None) and {r.pointer: r.text for r in rows if r.id == i} == (want or {})
    back = df.where("id = 2").select(requests.written_back(F.col("body"), F.array(F.lit("messages/0/tool_calls/0/function/arguments/to~1x")), F.array(F.lit("X"))).alias("b")).first().b
    assert json.loads(json.loads(back)["messages"][0]["tool_calls"][0]["function"]["arguments"]) == {"to/x": "X", "n": 5}


def test_suffixes(spark):
    want = {0: "A1", 1: "A2", 8: "A9", 9: "B1", 17: "B9", 18: "C1", 225: "Z1", 233: "Z9", 234: "AA1", 243: "AB1"}
    rows = spark.range(1000).select("id", placeholder.suffix(F.col("id")).alias("s")).collect()
    assert {r.id: r.s for r in rows if r.id in want} == want
    assert len({r.s for r in rows}) == 1000
    with pytest.raises(Exception, match="negative"):
        spark.range(1).select(placeholder.suffix(F.col("id") - 1)).collect()


def test_unknown_and_repeated_names():
    with pytest.raises(KeyError):
        normalize.get("none")
    with pytest.raises(ValueError):
        validate.register("luhn")(lambda x: x)
