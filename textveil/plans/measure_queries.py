"""Queries over sizes, latencies and rolling figures, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate, running

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def _ranked(values: str, fraction: float) -> str:
    """The value of nearest rank in a sorted list, halves to the even rank, as SQL."""
    return f"{values}[round_even({fraction} * (len({values}) - 1), 0)::BIGINT + 1]"


@query(
    "latency_percentiles",
    f"""
    SELECT event_type, round((v[(len(v) - 1) // 2 + 1] + v[len(v) // 2 + 1]) / 2, 6) AS p50, {_ranked("v", 0.95)} AS p95, {_ranked("v", 0.99)} AS p99, len(v) AS n
    FROM (SELECT event_type, list_sort(list(value)) AS v FROM events WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY 1) q
    """,
)
def latency_percentiles(spark, sf_dir):
    found = running.order_statistics(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", "value"), ["event_type"], "value", {"p95": 0.95, "p99": 0.99})
    return found.select("event_type", F.round("median", 6).alias("p50"), "p95", "p99", "n")


@query("corpus_sizes", "SELECT source, len(v) AS n, v[1] AS least, v[len(v) // 2 + 1] AS median_bytes, v[len(v)] AS most FROM (SELECT source, list_sort(list(strlen(coalesce(text, ''))::BIGINT)) AS v FROM documents GROUP BY 1) q")
def corpus_sizes(spark, sf_dir):
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint")
    found = running.order_statistics(spark.read.parquet(f"{sf_dir}/documents.parquet").select("source", size.alias("bytes")), ["source"], "bytes")
    return found.select("source", "n", "least", F.col("upper_median").alias("median_bytes"), "most")


@query(
    "rolling_latency",
    "SELECT event_id, event_type, round(median(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 1023 PRECEDING AND CURRENT ROW), 6) AS p50 FROM events WHERE value IS NOT NULL AND NOT isnan(value)",
)
def rolling_latency(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type", "ts", "value")
    return running.rolling_median(events, ["ts", "event_id"], "value", 1024, ["event_type"]).select("event_id", "event_type", F.round("p50", 6).alias("p50"))


@query("requests_so_far", "SELECT event_id, row_number() OVER w - 1 AS requests, coalesce(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS errors FROM events WINDOW w AS (ORDER BY ts, event_id)")
def requests_so_far(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type", "ts")
    sums = {"requests": F.lit(1).cast("bigint"), "errors": F.when(F.col("event_type") == "error", 1).otherwise(0)}
    return running.running(events, [], ["ts", "event_id"], sums).select("event_id", "requests", "errors")


@query(
    "speed_and_quality",
    """
    WITH c AS (SELECT event_type || strftime(ts, '%d') AS configuration, median(value) FILTER (value IS NOT NULL AND NOT isnan(value)) AS p50,
        sum(CASE WHEN event_id % 12 < 11 THEN 1 ELSE 0 END) / count(*) AS recall, sum(CASE WHEN event_id % 8 < 7 THEN 1 ELSE 0 END) / count(*) AS precision FROM events GROUP BY 1),
    s AS (SELECT configuration, round(p50, 6) AS p50, CASE WHEN recall >= 0.9 AND precision >= 0.85 THEN 'ok' ELSE 'below' END AS status FROM c)
    SELECT *, coalesce(status = 'ok' AND p50 = (SELECT min(p50) FROM s WHERE status = 'ok'), false) AS best FROM s
    """,
)
def speed_and_quality(spark, sf_dir):
    """Each event type and day as a configuration: its median, its shares of found and fine rows, and which is the fastest that is good enough."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    named = events.select(F.concat("event_type", F.date_format("ts", "dd")).alias("configuration"), "value", (F.col("event_id") % 12 < 11).cast("int").alias("found"), (F.col("event_id") % 8 < 7).cast("int").alias("fine"))
    medians = running.order_statistics(named, ["configuration"], "value").select(F.col("configuration").alias("__c"), F.round("median", 6).alias("p50"))
    shares = named.groupBy("configuration").agg((F.sum("found") / F.count("*")).alias("recall"), (F.sum("fine") / F.count("*")).alias("precision"))
    both = shares.join(medians, F.col("configuration").eqNullSafe(F.col("__c")), "left")
    return evaluate.gated(both).select("configuration", "p50", "status", "best")
