"""Web archives: writing WARC files with Spark's text writer and reading them by verified boundaries.

A file is read as pieces between occurrences of the version line, wherever those stand.  Each
piece is a candidate record with an offset and, from its header, the offset of its successor.
Pointer jumping from the start of each file keeps what the chain reaches; a version line inside a
payload is not reached, and its piece goes back to the payload it was cut from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SLIM_ROWS, cut, fresh_path, pick, slim_join, stored

#: Fixed values of the format.
VERSION = "WARC/1.1\r\n"
BLANK = "\r\n\r\n"
MIN_REVISIT_BYTES = 100
_V = len(VERSION)


def payload_facts(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest of each row; a null payload is empty."""
    rows = pick(pages, *dict.fromkeys([page_id, url, html]))
    rows = rows.select(F.col(f"`{page_id}`").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"), F.coalesce(F.col(f"`{html}`").cast("string"), F.lit("")).alias("payload"))
    raw = F.col("payload").cast("binary")
    return rows.withColumns({"payload_bytes": F.octet_length("payload").cast("bigint"), "payload_digest": F.sha2(raw, 256)})


def write_warc(pages: DataFrame, path: str, **names: str) -> None:
    """One record per row of ``pages`` under ``path``.

    Of rows with equal payloads of ``MIN_REVISIT_BYTES`` bytes or more, that with the smallest
    page_id becomes a response, the others revisit it and carry no payload.  Rows with a null
    page_id stay responses.  Files are cut at Spark's partitions and compressed with gzip.
    """
    rows = payload_facts(pages, **names)
    long = rows.where(F.col("payload_bytes") >= MIN_REVISIT_BYTES)
    first = long.groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.count("page_id").alias("copies"))
    first = first.where(F.col("copies") > 1).select("payload_digest", "first_id")
    rows = slim_join(rows, first, "payload_digest", "left")
    revisit = F.coalesce((F.col("page_id") != F.col("first_id")) & (F.col("payload_bytes") >= MIN_REVISIT_BYTES), F.lit(False))
    # The id as text, but a null as an empty id; the url with what would end a header line taken out.
    name = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    uri = F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), "[\r\n]", "")
    header = F.concat(
        F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: <urn:page:"), name, F.lit(">\r\nWARC-Target-URI: "), uri,
        F.lit("\r\nWARC-Payload-Digest: sha256:"), F.col("payload_digest"),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Refers-To: <urn:page:"), F.col("first_id").cast("string"), F.lit(">"))).otherwise(""),
        F.lit("\r\nContent-Length: "), F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes")).cast("string"), F.lit(BLANK),
    )
    record = F.concat(F.lit(VERSION), header, F.when(revisit, "").otherwise(F.col("payload")))
    rows.select(record.alias("value")).write.option("lineSep", BLANK).option("compression", "gzip").text(path)


def _field(name: str) -> Column:
    return F.nullif(F.regexp_extract(F.concat(F.lit("\r\n"), F.col("head"), F.lit("\r\n")), rf"(?i)\r\n{name}:[ \t]*([^\r\n]*)\r\n", 1), F.lit(""))


def _key() -> Column:
    """Names a piece by what it holds, so that a second scan finds it again in whatever order it reads."""
    return F.sha2(F.col("value").cast("binary"), 256).alias("key")


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """What follows each version line, wherever it stands, up to the next: a candidate record.

    file, split, pos (order in the file), key, len, what its header says if it has one, and the
    digest of as many bytes of its body as the header promises; not the body itself.
    """
    raw = spark.read.option("lineSep", VERSION).text(path)
    raw = raw.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("pos"))
    raw = raw.withColumn("head", F.when(F.locate(BLANK, F.col("value")) > 0, F.substring_index("value", BLANK, 1)))
    head = F.octet_length("head") + len(BLANK)
    length = _field("Content-Length").try_cast("bigint")
    page = lambda c: F.regexp_extract(c, "^<urn:page:(.*)>$", 1)
    out = raw.select(
        "file", "split", "pos", (F.octet_length("value") + F.lit(_V)).cast("bigint").alias("len"), _key(), head.cast("bigint").alias("head"), F.when(length >= 0, length).alias("length"),
        _field("WARC-Type").alias("record_type"), page(_field("WARC-Record-ID")).alias("page"), _field("WARC-Target-URI").alias("url"),
        F.regexp_replace(_field("WARC-Payload-Digest"), "^sha256:", "").alias("digest"), page(_field("WARC-Refers-To")).alias("refers"),
        F.sha2(F.substring(F.col("value").cast("binary"), (head + 1).cast("int"), length.cast("int")), 256).alias("computed"),
    )
    return stored(out, "warc-pieces")


def offsets(found: DataFrame) -> DataFrame:
    """file, pos, at (offset of the version line), next (offset of the successor, null without a header).

    Offsets are sums of piece lengths: within a split by position, before it from the totals of
    the splits, which are all that meets by file.
    """
    totals = found.groupBy("file", "split").agg(F.sum("len").alias("len"))
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("file", "split", F.coalesce(F.sum("len").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy("file", "split").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    places = found.select("file", "split", "pos", "len", "head", "length").withColumn("before", F.coalesce(F.sum("len").over(inside), F.lit(0)))
    places = places.join(totals, ["file", "split"]).withColumn("at", F.col("base") + F.col("before") - _V).where(F.col("at") >= 0)
    return places.select("file", "pos", "at", (F.col("at") + _V + F.col("head") + F.col("length") + len(BLANK)).alias("next"), (F.col("at") + F.col("len")).alias("end"))


def reachable(chain: DataFrame) -> DataFrame:
    """(file, at) of the records that the successors reach from offset 0, by pointer jumping.

    After round k a pointer leads 2**k records on and all records of the first 2**k are known, so
    the rounds grow with the logarithm of the longest file; each joins by file and offset.
    """
    tasks = max(1, chain.count() // SLIM_ROWS)
    jumps = places = cut(chain.select("file", "at", "next").coalesce(tasks))
    known = cut(jumps.where(F.col("at") == 0).select("file", "at"))
    while True:
        # Those that a pointer leads to from a known record, if a candidate stands there: as the
        # chain is one line, none of them is known yet, and none is reached twice.
        led = slim_join(known, jumps, ["file", "at"]).select("file", F.col("next").alias("at"))
        led = cut(slim_join(led, places.select("file", "at"), ["file", "at"], "left_semi"))
        if led.isEmpty():
            return known
        known = cut(known.union(led).coalesce(tasks))
        far = jumps.select("file", F.col("at").alias("next"), F.col("next").alias("far"))
        jumps = cut(slim_join(jumps.where(F.col("next").isNotNull()), far, ["file", "next"]).select("file", "at", F.col("far").alias("next")))


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Verified records: file, at, record_type, page (text of the id), url, digest, refers (text), length, computed.

    ``computed`` is the SHA-256 of the payload read.  Where a version line inside a payload cut
    it, it is put together again, and only then are payloads moved; with ``payload`` they are a
    column as well.
    """
    found = pieces(spark, path)
    places = cut(offsets(found))
    true = reachable(places)
    marks = places.join(true.withColumn("record", F.col("at")), ["file", "at"], "left")
    last = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    marks = cut(marks.withColumn("record", F.last("record", ignorenulls=True).over(last)).withColumn("split_up", F.coalesce(F.col("next"), F.lit(0)) > F.col("end")))
    heads = marks.where(F.col("record") == F.col("at"))
    fields = ["file", "at", "record_type", "page", "url", "digest", "refers", "length", "computed"]
    body = F.substring(F.col("value").cast("binary"), (F.col("head") + 1).cast("int"), F.col("length").cast("int"))
    texts = lambda wanted: slim_join(spark.read.option("lineSep", VERSION).text(path).select("value", _key()), wanted.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"])
    whole = found.join(heads.where(~F.col("split_up")).select("file", "pos", "at"), ["file", "pos"])
    if payload:
        whole = whole.join(texts(whole), "key").withColumn("payload", body)
    whole = whole.select(*fields, *["payload"] * payload)
    # Records with pieces of their own payload after them.
    broken = cut(heads.where("split_up").select("file", F.col("at").alias("record")))
    if broken.isEmpty():
        return whole
    parts = found.join(marks.join(broken, ["file", "record"], "left_semi").select("file", "pos", "at", "record"), ["file", "pos"])
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]), VERSION)
    text = parts.select("file", "record", "at", "key").join(texts(parts), "key").groupBy("file", "record").agg(joined.alias("value"))
    parts = parts.where(F.col("at") == F.col("record")).join(text, ["file", "record"])
    parts = parts.withColumn("payload", body).withColumn("computed", F.sha2("payload", 256))
    return whole.unionByName(parts.select(*fields, *["payload"] * payload))


def archive_round_trip(pages: DataFrame, path: str | None = None, **names: str) -> DataFrame:
    """Write ``pages`` as WARC files, read them back and return one row per page.

    page_id, payload_bytes, payload_digest, record_type, refers_to.  The digest of a response is
    computed from the bytes read; a revisit has length and digest of the response it refers to.
    Null payloads count as empty; rows that repeat a page_id stay rows of their own; a null
    page_id stays null and is never referred to; an empty table gives no rows.
    """
    spark = pages.sparkSession
    path = path or fresh_path(spark, "warc")
    write_warc(pages, path, **names)
    kind = pages.schema[names.get("page_id", "page_id")].dataType
    records = read_warc(spark, path, payload=False)
    records = cut(records.select(
        F.nullif(F.col("page"), F.lit("")).cast(kind).alias("page_id"), "record_type", F.nullif(F.col("refers"), F.lit("")).cast(kind).alias("refers_to"),
        F.col("length").alias("n"), "computed", "digest",
    ))
    full = records.where(F.col("record_type") == "response")
    # A response of that id with that digest; ids may repeat, so it is found once.
    target = full.groupBy(F.col("page_id").alias("refers_to"), F.col("computed").alias("digest")).agg(F.max("n").alias("m"))
    again = records.where(F.col("record_type") == "revisit").join(target, ["refers_to", "digest"])
    out = full.select("page_id", F.col("n").alias("payload_bytes"), F.col("computed").alias("payload_digest"), "record_type", F.lit(None).cast(kind).alias("refers_to"))
    return out.unionByName(again.select("page_id", F.col("m").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to"))
