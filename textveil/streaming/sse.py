"""Server-sent events from bytes cut anywhere, and events to bytes.

Line breaks are counted along a stream, so each piece of a chunk knows its line, whichever task reads
it; a stream of any length is spread over tasks, and only the pieces of one line or one event meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.running import running

BYTES = "ISO-8859-1"


def encoded(event: Column, data: Column) -> Column:
    """One event as bytes: a line for its name unless that is null, a line for each line of ``data`` (null: empty), a blank one."""
    lines = F.transform(F.split(F.coalesce(data, F.lit("")), "\n", -1), lambda line: F.concat(F.lit("data: "), line))
    return F.encode(F.concat(F.coalesce(F.concat(F.lit("event: "), event, F.lit("\n")), F.lit("")), F.array_join(lines, "\n"), F.lit("\n\n")), "UTF-8")


def fields(block: Column) -> tuple[Column, Column]:
    """Name of an event (null: none) and its data lines, joined (null: none), from its lines."""
    line = lambda prefix: F.regexp_extract_all(block, F.lit(rf"(?md)^{prefix}: ?(.*)$"), F.lit(1))
    return F.nullif(F.get(line("event"), F.lit(0)), F.lit("")), F.when(F.size(line("data")) > 0, F.array_join(line("data"), "\n"))


def rewritten(block: Column, data: Column) -> Column:
    """The lines of an event with ``data`` in place of its first data line and without the others; other lines stay."""
    is_data = lambda line: line.startswith("data:")
    lines = F.split(block, "\n", -1)
    first = F.array_position(F.transform(lines, is_data), True)
    new = F.transform(lines, lambda line, i: F.when(i + 1 == first, F.concat(F.lit("data: "), data)).when(~is_data(line), line))
    return F.array_join(F.filter(new, lambda line: line.isNotNull()), "\n")


def lines_of(chunks: DataFrame) -> DataFrame:
    """stream_id, line, text of all lines of ``chunks`` (stream_id, seq, bytes), wherever they and their characters are cut.

    Null bytes are none; a carriage return before a line break goes with it; bytes that are no UTF-8 become U+FFFD.
    ``seq`` must differ within a stream.
    """
    raw = chunks.select("stream_id", "seq", F.split(F.decode(F.coalesce("bytes", F.lit(b"")), BYTES), "\n", -1).alias("pieces"))
    counted = running(raw, ["stream_id"], ["seq"], {"first": F.size("pieces") - 1})
    pieces = counted.select("stream_id", "seq", F.size("pieces").alias("n"), "first", F.posexplode("pieces").alias("i", "piece"))
    pieces = pieces.withColumn("line", (F.col("first") + F.col("i")).cast("bigint"))
    inner = (F.col("i") > 0) & (F.col("i") < F.col("n") - 1)
    cut = pieces.where(~inner).groupBy("stream_id", "line").agg(F.array_sort(F.collect_list(F.struct("seq", "piece"))).alias("p"))
    whole = pieces.where(inner).select("stream_id", "line", "piece").unionByName(cut.select("stream_id", "line", F.array_join("p.piece", "").alias("piece")))
    text = F.make_valid_utf8(F.encode(F.regexp_replace("piece", "\r\\z", ""), BYTES).cast("string"))
    return whole.select("stream_id", "line", text.alias("text"))


def events(chunks: DataFrame) -> DataFrame:
    """stream_id, pos, event, data, block of the events in ``chunks`` (stream_id, seq, bytes).

    ``pos`` orders a stream's events, with gaps where blank lines repeat; ``block`` holds an event's lines.
    The last event counts without a blank line after it, as its bytes are owed too.
    """
    blank = F.col("text") == ""
    placed = running(lines_of(chunks), ["stream_id"], ["line"], {"pos": F.when(blank, 1).otherwise(0)})
    blocks = placed.where(~blank).groupBy("stream_id", "pos").agg(F.array_sort(F.collect_list(F.struct("line", "text"))).alias("l"))
    out = blocks.select("stream_id", "pos", F.array_join("l.text", "\n").alias("block"))
    name, data = fields(F.col("block"))
    return out.select("stream_id", "pos", name.alias("event"), data.alias("data"), "block")
