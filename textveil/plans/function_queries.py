"""Queries over the scalar functions, with SQL that states the expected rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import finders, normalize, placeholder, validate
from . import synth

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_N = "CAST(c_custkey AS VARCHAR(20))"
_K9 = synth._KEY
_MOBILE = f"'+49170' || {synth.LINE}"


def _cases(*values: str) -> str:
    return "CASE c_custkey % " + str(len(values)) + " " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


#: Name to spellings and the keys they get, in turn by customer number.
_NORMALIZE = {
    "phone": [
        (synth.PHONE, _MOBILE), (f"'0170/' || {synth.LINE}", _MOBILE), (f"'+49 (0) 170-' || {synth.LINE}", _MOBILE), (f"'0049170' || {synth.LINE}", _MOBILE), (f"'49170' || {synth.LINE}", _MOBILE),
        (f"'Aktenzeichen ' || {_N}", _N), (f"'0151 ' || {synth.LINE}", f"'0151' || {synth.LINE}"), (f"'+43 664 ' || {synth.LINE}", f"'+43664' || {synth.LINE}"),
    ],
    "email": [(f"'  Max.' || {_N} || '@Test.DE '", f"'max.' || {_N} || '@test.de'"), (f"'a b' || {_N} || '@x.io'", f"'ab' || {_N} || '@x.io'")],
    "person": [
        (f"'Dr. Max  Muster' || {_N}", f"'max muster' || {_N}"), (f"'Herrn Prof. Dr. Anna von Berg' || {_N}", f"'anna von berg' || {_N}"),
        (f"'WEISS' || {_N}", f"'weiss' || {_N}"), ("'Dr. Prof.'", "'dr. prof.'"), (f"'Weiß' || {_N}", f"'weiss' || {_N}"),
    ],
    "strip_upper": [(f"'de89 3704-' || {_N}", f"'DE893704' || {_N}"), (f"'a.b/c' || {_N}", f"'ABC' || {_N}")],
    "digits": [(f"'CVV: ' || {_N}", _N), (f"'4111 1111-' || {_N}", f"'41111111' || {_N}")],
    "casefold": [(f"'  Musterstraße   ' || {_N} || ' '", f"'musterstrasse ' || {_N}"), (f"c_name", "lower(c_name)")],
    "identity": [(f"' Sk-Live-' || {_N} || ' '", f"' Sk-Live-' || {_N} || ' '"), ("''", "''")],
    "date_iso": [("'1.' || CAST(c_custkey % 12 + 1 AS VARCHAR(2)) || '.2026'", "'2026-' || lpad(CAST(c_custkey % 12 + 1 AS VARCHAR(2)), 2, '0') || '-01'"), ("'2026-3-9'", "'2026-03-09'"), ("'12. Maerz 2026'", "'12. maerz 2026'")],
    "expiry": [("'08 / 27'", "'08/27'"), ("'08-2027'", "'08/27'"), ("'Not a date'", "'not a date'")],
}

#: Name to values and whether they are valid, in turn by customer number.
_VALIDATE = {
    "iban_mod97": [(synth.IBAN, "true"), (synth.GROUPED, "true"), (f"'DE00' || substr({synth.IBAN}, 5)", f"{synth._MOD} = 97"), (f"substr({synth.IBAN}, 1, 14)", "false")],
    "luhn": [(synth.CARD, "true"), (f"substr({synth.CARD}, 1, 15) || CAST((CAST(substr({synth.CARD}, 16, 1) AS INT) + 1) % 10 AS VARCHAR(2))", "false"), ("'18'", "false"), (f"'4111 ' || substr({synth.CARD}, 5)", "true")],
    "tax_de": [("'36574261809'", "true"), (synth.VAT, "true"), (f"'FR' || {_K9}", "false"), (_K9, "false"), ("'13/371/08153'", "true")],
    "bank_routing_de": [("'37040044'", "true"), ("'deutdeff'", "true"), ("'DEUTDEFF50'", "false"), (_K9, "false")],
    "postal_de": [("'50667'", "true"), ("'5066'", "false"), ("lpad(CAST(c_custkey % 100000 AS VARCHAR(9)), 5, '0')", "true")],
    "ip_parse": [(synth.IP, "true"), ("'2001:db8::1'", "true"), ("'999.1.1.1'", "false"), ("'1.2.3'", "false")],
    "expiry_shape": [("'03/28'", "true"), ("'03/2028'", "true"), ("'13/28'", "false"), ("'Maerz'", "false")],
    "cvv_shape": [("'123'", "true"), ("'1234'", "true"), ("'12'", "false"), ("'12a'", "false")],
    "email_syntax": [(synth.EMAIL, "true"), ("'Systemmail'", "false"), (f"'a' || {_N} || '@b'", "false")],
    "phone_shape": [(synth.PHONE, "true"), ("'2024'", "false"), ("'+49 170 1234567'", "true")],
    "phone_valid": [
        (synth.PHONE, "true"), (f"'0151 ' || {synth.LINE}", "false"), (f"'0151 1' || {synth.LINE}", "true"), (f"'+1 123 ' || {synth.LINE}", "false"), (f"'+1 212 ' || {synth.LINE}", "true"),
        (f"'+33 0' || {synth.LINE} || '1'", "false"), (f"'+41 (0) 79 ' || {synth.LINE}", "true"), (f"'+999 ' || {_K9}", "false"),
    ],
}


def _add_normalizer(name: str, cases: list[tuple[str, str]]) -> None:
    source = f"SELECT c_custkey AS id, {_cases(*[v for v, _ in cases])} AS value FROM customer"
    QUERIES[f"normalize_{name}"] = lambda spark, d: synth.run_sql(spark, d, source, deal=True).select("id", normalize.normalize(F.col("value"), name).alias("norm"))
    SQL[f"normalize_{name}"] = f"SELECT c_custkey AS id, {_cases(*[k for _, k in cases])} AS norm FROM customer"


def _add_validator(name: str, cases: list[tuple[str, str]]) -> None:
    source = f"SELECT c_custkey AS id, {_cases(*[v for v, _ in cases])} AS value FROM customer"
    QUERIES[f"validate_{name}"] = lambda spark, d: synth.run_sql(spark, d, source, deal=True).select("id", validate.get(name)(F.col("value")).alias("valid"))
    SQL[f"validate_{name}"] = f"SELECT c_custkey AS id, {_cases(*[k for _, k in cases])} AS valid FROM customer"


def _add_letter_finder(kind: str, finder: str) -> None:
    n = next(i for i, p in enumerate(synth.PARTS) if p[1] == kind)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        letters = synth.run_sql(spark, sf_dir, synth.LETTERS, deal=True)
        out = letters.select("doc_id", F.inline(finders.get(finder)(F.col("text")))).select("doc_id", "start", "end", F.col("text").alias("surface"))
        # By chance, digits of the account and the telephone pass the card check as well.
        return out.where(F.col("surface").startswith("411111")) if kind == "CARD" else out

    QUERIES[f"find_{finder}_in_letters"] = run
    value = synth.PARTS[n][2]
    SQL[f"find_{finder}_in_letters"] = f'SELECT c_custkey AS doc_id, CAST({synth.part_start(n)} AS INT) AS start, CAST({synth.part_start(n)} + length({value}) AS INT) AS "end", {value} AS surface FROM customer'


def _add_document_finder(finder: str, pattern: str, check: str = "true") -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
        return docs.select("doc_id", F.inline(finders.get(finder)(F.col("text")))).select("doc_id", "start", "end", F.col("text").alias("surface"))

    QUERIES[f"detect_{finder}_spans"] = run
    SQL[f"detect_{finder}_spans"] = f"""
        WITH m AS (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS m, string_split_regex(text, '{pattern}') AS g FROM documents),
        u AS (SELECT doc_id, m[i] AS surface, (coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::INT AS start
              FROM (SELECT doc_id, m, g, unnest(range(1, len(m) + 1)) AS i FROM m) q)
        SELECT doc_id, start, (start + length(surface))::INT AS "end", surface FROM u WHERE {check}
    """


for _name, _c in _NORMALIZE.items():
    _add_normalizer(_name, _c)
for _name, _c in _VALIDATE.items():
    _add_validator(_name, _c)
for _kind, _f in (("IBAN", "iban"), ("CARD", "card"), ("EMAIL", "email"), ("PHONE", "phone"), ("IP", "ip"), ("TAX_ID", "vat_de")):
    _add_letter_finder(_kind, _f)
_add_document_finder("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)*\.[A-Za-z]{2,}")
_add_document_finder("ip", r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "len(list_filter(string_split(surface, '.'), lambda x: x::INT > 255 OR (len(x) > 1 AND x[1] = '0'))) = 0")
_add_document_finder(
    "card", r"\b\d(?:[ -]?\d){11,18}\b",
    "(SELECT sum(CASE WHEN (len(d) - i) % 2 = 1 THEN d[i]::INT * 2 - CASE WHEN d[i]::INT > 4 THEN 9 ELSE 0 END ELSE d[i]::INT END) % 10 FROM (SELECT d, unnest(range(1, len(d) + 1)) AS i FROM (SELECT string_split(regexp_replace(surface, '[^0-9]', '', 'g'), '') AS d) q) r) = 0",
)


def placeholder_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey")
    return keys.select("o_orderkey", placeholder.render(F.lit("PERSON"), F.col("o_orderkey") % 6000).alias("placeholder"))


def placeholder_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = synth.run_sql(spark, sf_dir, "SELECT o_orderkey, 'An [[PERSON_A' || CAST(o_orderkey % 9 + 1 AS VARCHAR(2)) || ']] und [[lower_a1]] [[CARD_EXPIRY_B2]] [[X-A1]]' AS text FROM orders")
    both = F.arrays_zip(placeholder.found(F.col("text")).alias("p"), placeholder.found(F.col("text"), 1).alias("t"), placeholder.found(F.col("text"), 2).alias("s"))
    return texts.select("o_orderkey", F.posexplode(both).alias("pos", "x")).select("o_orderkey", "pos", F.col("x.p").alias("placeholder"), F.col("x.t").alias("type"), F.col("x.s").alias("suffix"))


def placeholder_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = synth.run_sql(spark, sf_dir, "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'x [[IBAN_A1]]' ELSE '[ref][x] [[nicht_das]]' END AS text FROM orders")
    return texts.select("o_orderkey", placeholder.contains(F.col("text")).alias("taken"))


QUERIES |= {"placeholder_encode": placeholder_encode, "placeholder_parse": placeholder_parse, "placeholder_guard": placeholder_guard}
SQL |= {
    "placeholder_encode": """
        SELECT o_orderkey, '[[PERSON_' || CASE WHEN b < 26 THEN chr((65 + b)::INT) ELSE chr((64 + b // 26)::INT) || chr((65 + b % 26)::INT) END || (i % 9 + 1) || ']]' AS placeholder
        FROM (SELECT o_orderkey, o_orderkey % 6000 AS i, (o_orderkey % 6000) // 9 AS b FROM orders) q
    """,
    "placeholder_parse": """
        SELECT o_orderkey, pos::INT AS pos, CASE pos WHEN 0 THEN '[[PERSON_A' || (o_orderkey % 9 + 1) || ']]' ELSE '[[CARD_EXPIRY_B2]]' END AS placeholder,
          CASE pos WHEN 0 THEN 'PERSON' ELSE 'CARD_EXPIRY' END AS type, CASE pos WHEN 0 THEN 'A' || (o_orderkey % 9 + 1) ELSE 'B2' END AS suffix FROM orders, range(2) t(pos)
    """,
    "placeholder_guard": "SELECT o_orderkey, o_orderkey % 3 = 0 AS taken FROM orders",
}
