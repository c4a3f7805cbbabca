"""Texts derived from the tables by SQL that Spark and DuckDB read alike: inputs of queries and their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents conversations pages".split()


def dealt(df: DataFrame) -> DataFrame:
    """Slim rows dealt over all cores: a file of some MB is few tasks, whatever is then made of each row."""
    spark = df.sparkSession
    return df.repartition(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def run_sql(spark: SparkSession, sf_dir: str, sql: str, deal: bool = False) -> DataFrame:
    """``sql`` over the tables that it names; ``deal``: over their rows dealt."""
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if t in sql}
    used = {t: dealt(df) if deal else df for t, df in used.items()}
    for name, df in used.items():
        df.createOrReplaceTempView(f"tv_{name}")
        sql = sql.replace(f"FROM {name}", f"FROM tv_{name}").replace(f"JOIN {name}", f"JOIN tv_{name}")
    return spark.sql(sql)


def _luhn(digits: str, n: int) -> str:
    """Check digit of the text expression ``digits`` of n (odd) digits."""
    terms = []
    for i in range(1, n + 1):
        d = f"CAST(substr({digits}, {i}, 1) AS INT)"
        terms.append(f"({d} * 2 - CASE WHEN {d} > 4 THEN 9 ELSE 0 END)" if i % 2 else d)
    return f"CAST((10 - ({' + '.join(terms)}) % 10) % 10 AS VARCHAR(2))"


_KEY = "lpad(CAST(c_custkey AS VARCHAR(20)), 9, '0')"
_BBAN = f"'370400440' || {_KEY}"
_CARD = f"('411111' || {_KEY})"
_MOD = f"(98 - CAST(CAST({_BBAN} || '131400' AS DECIMAL(38, 0)) % 97 AS INT))"
IBAN = f"('DE' || lpad(CAST({_MOD} AS VARCHAR(3)), 2, '0') || {_BBAN})"
CARD = f"({_CARD} || {_luhn(_CARD, 15)})"
EMAIL = "('kunde' || CAST(c_custkey AS VARCHAR(20)) || '@bank' || CAST(c_nationkey AS VARCHAR(9)) || '.de')"
#: The subscriber's digits of a mobile number with prefix 170.
LINE = "lpad(CAST(c_custkey AS VARCHAR(20)), 7, '0')"
PHONE = f"('+49 170 ' || {LINE})"
IP = "('10.' || CAST(c_nationkey AS VARCHAR(9)) || '.' || CAST(c_custkey % 256 AS VARCHAR(9)) || '.' || CAST(c_custkey % 7 AS VARCHAR(9)))"
VAT = f"('DE' || {_KEY})"
GROUPED = f"(substr({IBAN}, 1, 4) || ' ' || substr({IBAN}, 5, 4) || ' ' || substr({IBAN}, 9, 4) || ' ' || substr({IBAN}, 13, 4) || ' ' || substr({IBAN}, 17, 4) || ' ' || substr({IBAN}, 21, 2))"

#: One text per customer with a value of each rule type, in this order, and what stands before each.
PARTS = [("Konto ", "IBAN", GROUPED), (", Karte ", "CARD", CARD), (", Mail ", "EMAIL", EMAIL), (", Tel. ", "PHONE", PHONE), (", Server ", "IP", IP), (", USt ", "TAX_ID", VAT)]
LETTER = " || ".join(f"'{lead}' || {value}" for lead, _, value in PARTS) + " || '.'"
LETTERS = f"SELECT c_custkey AS doc_id, {LETTER} AS text FROM customer"


def part_start(n: int) -> str:
    """Offset of the n-th value of a letter, as SQL."""
    return " + ".join([*(f"length({v})" for _, _, v in PARTS[:n]), str(sum(len(lead) for lead, _, _ in PARTS[: n + 1]))])
