"""Streams of the responses protocol: events in which no placeholder is cut, numbered anew.

Texts are held back while a placeholder may be cut; fragments of tool-call arguments are kept until
the call is whole.  What is held when an answer ends, or just stops, goes out as events of its own.
Values are put back afterwards, by joins (``operators.bodies.restored_bodies``).
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .holdback import MAX_HELD, feed

#: The events that carry texts and arguments in pieces, those that close them, and those that end an answer.
DELTAS = {"response.output_text.delta": "response.output_text.done", "response.refusal.delta": "response.refusal.done"}
CLOSING = {v: k for k, v in DELTAS.items()}
ARGUMENTS, ARGUMENTS_DONE = "response.function_call_arguments.delta", "response.function_call_arguments.done"
ENDS = ("response.completed", "response.incomplete", "response.failed")
OUT = "stream_id string, seq bigint, part int, data string"
#: Milliseconds without an event after which a stream counts as stopped.
IDLE_MS = 600_000


class Fold:
    """What one stream holds: texts and arguments by key, each with the event (without its piece) that can carry it on."""

    def __init__(self, number: int = 0, texts: dict[str, tuple[str, dict]] | None = None, calls: dict[str, tuple[str, dict]] | None = None, lenient: bool = False, most: int = MAX_HELD):
        self.number, self.texts, self.calls, self.lenient, self.most = number, texts or {}, calls or {}, lenient, most
        self.ended = False

    def numbered(self, event: dict) -> dict:
        """Events are added and dropped, so those that have a number get this stream's own."""
        if "sequence_number" in event:
            event["sequence_number"], self.number = self.number, self.number + 1
        return event

    def rest(self) -> Iterator[dict]:
        """Texts that are held, then arguments that came in part."""
        for held, frame in self.texts.values():
            if held:
                yield self.numbered({**frame, "delta": held})
        for text, frame in self.calls.values():
            if text:
                yield self.numbered({**frame, "delta": text})
        self.texts, self.calls = {}, {}

    def step(self, event: dict) -> Iterator[dict]:
        kind, piece = event.get("type"), event.get("delta")
        frame = {k: v for k, v in event.items() if k != "delta"}
        place = json.dumps([event.get(k) for k in ("item_id", "output_index", "content_index")] + [kind in DELTAS and kind or CLOSING.get(kind)])
        call = json.dumps(event.get("item_id"))
        if kind in DELTAS and isinstance(piece, str):
            out, held = feed(self.texts.get(place, ("",))[0], piece, False, self.most, self.lenient)
            self.texts[place] = held, frame
            yield self.numbered({**event, "delta": out})
        elif kind in CLOSING:
            held = self.texts.pop(place, ("",))[0]
            if held:
                yield self.numbered({**{k: v for k, v in event.items() if k not in ("text", "refusal")}, "type": CLOSING[kind], "delta": held})
            yield self.numbered(event)
        elif kind == ARGUMENTS:
            if isinstance(piece, str):
                self.calls[call] = self.calls.get(call, ("",))[0] + piece, frame
        elif kind == ARGUMENTS_DONE:
            kept = self.calls.pop(call, ("",))[0]
            whole = event["arguments"] if isinstance(event.get("arguments"), str) else kept
            # One piece with all of it, for readers of pieces alone.
            yield self.numbered({**{k: v for k, v in event.items() if k != "arguments"}, "type": ARGUMENTS, "delta": whole})
            yield self.numbered({**event, "arguments": whole})
        else:
            if kind in ENDS:
                self.ended = True
                yield from self.rest()
            yield self.numbered(event)

    def rows(self, events: Iterable[tuple[int, str]]) -> Iterator[tuple[int, int, str]]:
        """(seq, part, data) of the events that take the place of each; what is no JSON object passes as it is."""
        for seq, data in events:
            try:
                event = json.loads(data)
            except (TypeError, ValueError):
                event = None
            out = self.step(event) if isinstance(event, dict) else None
            if out is None:
                # A reader may stop at the sentinel, so what is held goes out in front of it.
                texts = [json.dumps(x, ensure_ascii=False) for x in self.rest()] if (data or "").strip() == "[DONE]" else []
                texts.append(data)
            else:
                texts = [json.dumps(x, ensure_ascii=False) for x in out]
            yield from ((seq, part, text) for part, text in enumerate(texts))


def _frame(stream: str, rows: list[tuple[int, int, str]]) -> pd.DataFrame:
    seq, part, data = zip(*rows, strict=True) if rows else ((), (), ())
    return pd.DataFrame({"stream_id": pd.Series([stream] * len(rows), dtype=object), "seq": pd.Series(seq, dtype="int64"), "part": pd.Series(part, dtype="int32"), "data": pd.Series(data, dtype=object)})


class _Relay(StatefulProcessor):
    """One stream's fold between triggers: its counters, held texts, fragments, and a timer for streams that stop."""

    def __init__(self, lenient: bool, idle_ms: int):
        self.lenient, self.idle_ms = lenient, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getValueState("counts", "number bigint, seq bigint")
        self.texts = handle.getMapState("texts", "key string", "held string, frame string")
        self.calls = handle.getMapState("calls", "key string", "held string, frame string")

    def _loaded(self) -> tuple[Fold, int]:
        number, seq = self.counts.get() if self.counts.exists() else (0, -1)
        kept = [{k[0]: (v[0], json.loads(v[1])) for k, v in state.iterator()} if state.exists() else {} for state in (self.texts, self.calls)]
        return Fold(number, *kept, lenient=self.lenient), seq

    def _timers(self) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at[0] if isinstance(at, tuple) else at)

    def _clear(self) -> None:
        for state in (self.counts, self.texts, self.calls):
            state.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        fold, seq = self._loaded()
        # Only the events of one stream in one trigger are gathered, to set them in order.
        batch = pd.concat(list(rows)).sort_values("seq")
        out = list(fold.rows(zip(batch["seq"].tolist(), batch["data"].tolist(), strict=True)))
        self._timers()
        self._clear()
        if not fold.ended:
            self.counts.update((fold.number, int(max(seq, batch["seq"].max()))))
            for state, kept in ((self.texts, fold.texts), (self.calls, fold.calls)):
                for k, (held, frame) in kept.items():
                    state.updateValue((k,), (held, json.dumps(frame, ensure_ascii=False)))
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield _frame(key[0], out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        fold, seq = self._loaded()
        out = [(seq + 1, part, json.dumps(x, ensure_ascii=False)) for part, x in enumerate(fold.rest())]
        self._clear()
        yield _frame(key[0], out)

    def close(self) -> None:
        pass


def relayed_stream(events: DataFrame, lenient: bool = False, idle_ms: int = IDLE_MS) -> DataFrame:
    """Streaming ``events`` (stream_id, seq, data) to those a client gets: stream_id, seq, part, data.

    State goes with the event that ends an answer, or ``idle_ms`` after the last event; then what is
    held goes out too, after the last event's number.  Needs the RocksDB state store.
    """
    return events.groupBy("stream_id").transformWithStateInPandas(_Relay(lenient, idle_ms), OUT, "append", "processingTime")


def relayed_batch(events: DataFrame, lenient: bool = False) -> DataFrame:
    """The same over a finished table; a stream's last event is its end."""

    def ended(stream: str, fold: Fold, seq: int) -> list[tuple]:
        return [(stream, seq + 1, part, json.dumps(x, ensure_ascii=False)) for part, x in enumerate(fold.rest())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, fold, last = None, None, 0
        for batch in itertools.chain(batches, [None]):
            out = []
            for name, seq, data in zip(*[c.to_pylist() for c in batch.columns], strict=True) if batch is not None else ():
                if fold is None or name != stream:
                    out += ended(stream, fold, last) if fold else []
                    stream, fold = name, Fold(lenient=lenient)
                out += [(name, *row) for row in fold.rows([(seq, data)])]
                last = seq
            if batch is None and fold:
                out += ended(stream, fold, last)
            columns = zip(*out, strict=True) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int32(), pa.string()), strict=True)], names=["stream_id", "seq", "part", "data"])

    # Sorted events of many streams go to Python together: a group of its own for each costs more than its events.
    return events.select("stream_id", "seq", "data").repartition("stream_id").sortWithinPartitions("stream_id", "seq").mapInArrow(run, OUT)
