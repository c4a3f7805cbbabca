"""Restoring answers that come in pieces: a placeholder cut between pieces is held back until it is whole."""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.placeholder import PLACEHOLDER
from ..operators.pseudonymize import reverse

#: What may be the beginning of a placeholder at the end of a text, and of one that lost a bracket.
TAIL, LENIENT_TAIL = r"\[(?:\[(?:[A-Z][A-Z0-9_]*\]?)?)?$", r"\[\[?(?:[A-Z][A-Z0-9_]*\]?)?$"
_TAIL, _LENIENT, _WHOLE = re.compile(TAIL), re.compile(LENIENT_TAIL), re.compile(PLACEHOLDER)
MAX_HELD = 96
OUT, STATE = "stream_id string, choice int, seq bigint, released string", "held string"


def feed(held: str, delta: str, last: bool, most: int = MAX_HELD, lenient: bool = False) -> tuple[str, str]:
    """(released, held): all but a tail that may begin a placeholder; everything at the end or over ``most``."""
    text = held + (delta or "")
    cut = None if last else (_LENIENT if lenient else _TAIL).search(text)
    if cut is None or len(text) - cut.start() > most:
        return text, ""
    return text[: cut.start()], text[cut.start() :]


def _stepper(table: dict[str, str] | None, lenient: bool):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held, ended = state.get[0] if state.exists else "", False
        out = []
        # Only the rows of one stream's choice in one trigger are gathered, to set them in order.
        rows = pd.concat(list(batches)).sort_values("seq")
        for delta, last in zip(rows["delta"], rows["last"], strict=True):
            ended = bool(last)
            piece, held = feed(held, delta, ended, lenient=lenient)
            out.append(_WHOLE.sub(lambda m: table.get(m[0], m[0]), piece) if table else piece)
        if not ended:
            state.update((held,))
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"stream_id": key[0], "choice": int(key[1]), "seq": rows["seq"].astype("int64").to_numpy(), "released": out})

    return run


def restore_stream(deltas: DataFrame, table: dict[str, str] | None = None, lenient: bool = False) -> DataFrame:
    """Streaming ``deltas`` (stream_id, choice, seq, delta, last) to released pieces, with what is held as keyed state.

    The state of a choice goes with its last piece.  ``table``: the placeholders of one mapping, a
    small table; without it pieces hold whole placeholders, which ``restoring`` puts back by joins.
    ``lenient`` also holds back what may begin a placeholder that lost a bracket.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    return deltas.groupBy("stream_id", "choice").applyInPandasWithState(_stepper(table, lenient), OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def restoring(entries: DataFrame, streams: DataFrame, write: Callable[[DataFrame, int], None], lenient: bool = False) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: ``write`` gets the released pieces with ``mapping`` and ``restored``.

    ``streams`` (stream_id, mapping) names each stream's mapping, and only that mapping's
    ``entries`` are put back; a stream without one, and an unknown placeholder, stay as they are.
    """

    def run(batch: DataFrame, number: int) -> None:
        named = batch.join(streams.select("stream_id", "mapping").dropDuplicates(["stream_id"]), "stream_id", "left")
        write(reverse(named, entries, fuzzy=lenient, text="released"), number)

    return run


def released_batch(deltas: DataFrame, lenient: bool = False) -> DataFrame:
    """The pieces that ``restore_stream`` releases, over a finished table: a choice's last piece releases all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A row waits for the next one, which shows whether it is its choice's last.
        waiting, held = None, ""
        for batch in itertools.chain(batches, [None]):
            out = []
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True) if batch is not None else [None]:
                if waiting is not None:
                    piece, held = feed(held, waiting[3], row is None or row[:2] != waiting[:2], lenient=lenient)
                    out.append((*waiting[:3], piece))
                waiting = row
            columns = zip(*out, strict=True) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int64(), pa.string()), strict=True)], names=["stream_id", "choice", "seq", "released"])

    # Sorted rows of many streams go to Python together: a group of its own for each costs more than its pieces.
    dealt = deltas.select("stream_id", "choice", "seq", "delta").repartition("stream_id", "choice").sortWithinPartitions("stream_id", "choice", "seq")
    return dealt.mapInArrow(run, OUT)


def restore_batch(deltas: DataFrame) -> DataFrame:
    """The same over a finished table: stream_id, choice and the whole text of its pieces in order."""
    pieces = deltas.groupBy("stream_id", "choice").agg(F.array_sort(F.collect_list(F.struct("seq", "delta"))).alias("p"))
    return pieces.select("stream_id", "choice", F.array_join(F.col("p.delta"), "").alias("text"))


def assemble_calls(fragments: DataFrame) -> DataFrame:
    """stream_id, choice, call, name, arguments of tool calls from their fragments (seq, name, arguments) in order."""
    pieces = fragments.groupBy("stream_id", "choice", "call").agg(F.array_sort(F.collect_list(F.struct("seq", F.coalesce("name", F.lit("")).alias("name"), F.coalesce("arguments", F.lit("")).alias("arguments")))).alias("p"))
    return pieces.select("stream_id", "choice", "call", F.array_join(F.col("p.name"), "").alias("name"), F.array_join(F.col("p.arguments"), "").alias("arguments"))


def sse_events(raw: DataFrame, text: str = "raw") -> DataFrame:
    """Events of server-sent streams: the columns of ``raw``, pos, event, data; ``data`` lines of an event are joined."""
    blocks = F.filter(F.split(F.regexp_replace(F.col(text), "\r\n", "\n"), "\n\n", -1), lambda b: b != "")
    out = raw.select(*[c for c in raw.columns if c != text], F.posexplode(blocks).alias("pos", "block"))
    data = F.array_join(F.regexp_extract_all("block", F.lit(r"(?md)^data: ?(.*)$"), F.lit(1)), "\n")
    return out.withColumns({"event": F.nullif(F.regexp_extract("block", r"(?md)^event: ?(.*)$", 1), F.lit("")), "data": data}).drop("block")
