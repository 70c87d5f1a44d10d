"""R2: streamed responses assembled incrementally.

Event lines are parsed by Spark (VARIANT paths, as in the batch operator);
only line numbers and fragments reach Python, in
``groupBy(response).transformWithState``.  A micro-batch writes what it
brings and little more: its fragments are one chunk that is appended to a list
state, and one small value holds the end marker, the count of lines before it,
the first block of line numbers seen, as bits, and the newest chunk until it
has more than ``SHORT_CHARS``; later blocks are entries of a map state.  Every
call on the state is a message between Python and the JVM; a micro-batch of a
short response makes two.  When the marker *and*
every line before it have arrived, in whatever order and micro-batch, the
chunks are read once and leave as one row (the newest without having been
written), and the batch operator's own expressions put content and tool calls
together.

A response that never finishes is, with ``timeout_ms``, emitted as incomplete
after that processing time without news (a timer, set anew by every
micro-batch of the response); lines that arrive later begin a new
one (the reference has no rule for this; choose a timeout above the longest
gap of the source).  With ``timeout_ms=None`` nothing times out.  Use that
for ``trigger(availableNow=True)`` runs: processing-time timers make the
stateful operator request another (empty) batch forever.

The state lives in RocksDB, which the stateful operator needs; ``rocksdb_state``
sets it for the queries started inside it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators.responses import chunk_fields, first_of_each, merged_calls, parse_event_lines

DEFAULT_TIMEOUT_MS = 10 * 60 * 1000
#: Line numbers that one entry of the map state covers; lines and characters
#: of a chunk; characters of one that is kept in the small value.
BLOCK, CHUNK_LINES, CHUNK_CHARS, SHORT_CHARS = 4096, 10_000, 1 << 20, 4096
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb_state(spark: SparkSession):
    """Streaming queries started inside keep their state in RocksDB."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


class Assembler(StatefulProcessor):
    """Keeps a response's fragments until its end marker and every line
    before the marker have been seen; returns them as one row."""

    def __init__(self, key_col: str, first_line: int, timeout_ms: int | None):
        self.key_col, self.first_line, self.timeout_ms = key_col, first_line, timeout_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.parts = handle.getListState("chunks", "chunk string")
        self.seen = handle.getMapState("blocks", "block bigint", "bits binary")
        # last: the highest block seen; stored: whether the list has chunks;
        # bits: block 0; chunk: the newest one while it is short.
        self.progress = handle.getValueState(
            "state", "marker bigint, below bigint, timer bigint, last bigint, stored boolean, bits binary, chunk string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        marker, below, timer, last, stored, held, short = self.progress.get() or (None, 0, None, 0, False, None, None)
        known, bits, part = marker, self._bits(held), None
        for end, at, chunk in self._chunks(rows, short):
            if end is not None:
                marker = end if marker is None else min(marker, end)
            at = at[at >= self.first_line] - self.first_line
            below += self._mark(at, known, bits)
            last = max(last, int(at.max()) // BLOCK if len(at) else 0)
            if chunk[0]:
                # The newest chunk waits: if the response ends here, it needs no state.
                if part is not None:
                    self.parts.appendValue((self._text(part),))
                    stored = True
                part = chunk
        if marker != known:
            below = self._count(marker - self.first_line, bits, last)
        if marker is not None and below >= marker - self.first_line:
            yield self._leave(key, marker, timer, last, stored, part, held is not None)
            return
        short = None if part is None else self._text(part)
        if short is not None and len(short) > SHORT_CHARS:
            self.parts.appendValue((short,))
            stored, short = True, None
        if self.timeout_ms is not None:
            if timer is not None:
                self.handle.deleteTimer(timer)
            timer = timerValues.getCurrentProcessingTimeInMs() + self.timeout_ms
            self.handle.registerTimer(timer)
        self.progress.update((marker, below, timer, last, stored, np.packbits(bits).tobytes().rstrip(b"\0"), short))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        state = self.progress.get()
        if state is not None and state[2] == expiredTimerInfo.getExpiryTimeInMs():
            yield self._leave(key, None, None, state[3], state[4], state[6] and json.loads(state[6]), True)

    @staticmethod
    def _text(chunk) -> str:
        return json.dumps(chunk, ensure_ascii=False)

    @staticmethod
    def _chunks(rows: Iterator[Row], short: str | None) -> Iterator[tuple]:
        """Per bounded number of lines: the first end marker or None, the other
        lines' numbers, and number, content and tool calls of those with any;
        the first chunk goes on from ``short``."""
        end, at, chunk, size = None, [], json.loads(short) if short else ([], [], []), len(short or "")
        for row in rows:
            line_no = row["line_no"]
            if row["is_done"]:
                end = line_no if end is None else min(end, line_no)
                continue
            at.append(line_no)
            content, tools = row["content"], row["tool_json"]
            if content is not None or tools is not None:
                for values, x in zip(chunk, (line_no, content, tools)):
                    values.append(x)
                size += len(content or "") + len(tools or "")
            if len(at) >= CHUNK_LINES or size >= CHUNK_CHARS:
                yield end, np.array(at, np.int64), chunk
                end, at, chunk, size = None, [], ([], [], []), 0
        yield end, np.array(at, np.int64), chunk

    def _mark(self, at: np.ndarray, marker: int | None, first: np.ndarray) -> int:
        """Marks line positions as seen, those of block 0 in ``first``; how many
        below a known marker are new."""
        at, new = np.unique(at), 0
        for part in np.split(at, np.flatnonzero(np.diff(at // BLOCK)) + 1) if len(at) else ():
            block = int(part[0]) // BLOCK
            bits = self._bits((self.seen.getValue((block,)) or (None,))[0]) if block else first
            fresh = part[bits[part - block * BLOCK] == 0]
            if len(fresh):
                bits[fresh - block * BLOCK] = 1
                if block:
                    self.seen.updateValue((block,), (np.packbits(bits).tobytes(),))
                if marker is not None:
                    new += int((fresh < marker - self.first_line).sum())
        return new

    def _count(self, end: int, first: np.ndarray, last: int) -> int:
        """Positions seen below ``end``; read when a marker is new."""
        later = self.seen.iterator() if last else ()
        return int(first[:max(0, end)].sum()) + sum(
            int(self._bits(bits)[:max(0, end - block * BLOCK)].sum()) for (block,), (bits,) in later)

    @staticmethod
    def _bits(held) -> np.ndarray:
        return np.unpackbits(np.frombuffer(bytes(held or b"").ljust(BLOCK // 8, b"\0"), np.uint8))

    def _leave(self, key, marker: int | None, timer: int | None, last: int, stored: bool, part, known: bool) -> Row:
        """The response's row; only state that was written is read and cleared."""
        chunks = [json.loads(chunk) for (chunk,) in self.parts.get()] if stored else []
        if part is not None:
            chunks.append(part)
        held = [p for chunk in chunks for p in zip(*chunk) if marker is None or p[0] < marker]
        if timer is not None:
            self.handle.deleteTimer(timer)
        for state, written in ((self.parts, stored), (self.seen, last > 0), (self.progress, known)):
            if written:
                state.clear()
        return Row(**{self.key_col: key[0], "line_nos": [p[0] for p in held], "contents": [p[1] for p in held],
                      "tools": [p[2] for p in held], "complete": marker is not None})


def assembly_stream(lines: DataFrame, timeout_ms: int | None = DEFAULT_TIMEOUT_MS, key: str = "response_id",
                    order: str = "line_no", line_col: str = "line", first_line: int = 0) -> DataFrame:
    """Streaming (or batch) event lines ``key, order, line``, numbered from
    ``first_line`` without gaps -> one row per finished response: ``key,
    content, tool_calls_json, n_lines`` (lines with content or tool calls),
    ``complete``.  A line number counts once, as in ``assemble_responses``.
    Lines after the marker, and lines without a number, are no part of a response."""
    p = chunk_fields(parse_event_lines(lines, key, order, line_col))
    deltas = p.schema["tool_deltas"].dataType
    slim = p.select(F.col(key), F.col(order).cast("bigint").alias("line_no"), F.coalesce("is_done", F.lit(False)).alias("is_done"),
                    F.when(F.col("content") != "", F.col("content")).alias("content"),
                    F.when(F.size("tool_deltas") > 0, F.to_json("tool_deltas")).alias("tool_json")).where(F.col("line_no").isNotNull())
    schema = (f"`{key}` {lines.schema[key].dataType.simpleString()}, line_nos array<bigint>, contents array<string>, "
              "tools array<string>, complete boolean")
    whole = slim.groupBy(key).transformWithState(
        Assembler(key, first_line, timeout_ms), schema, "append", "None" if timeout_ms is None else "ProcessingTime")
    part = F.transform(F.arrays_zip("line_nos", "contents", "tools"), lambda x: F.struct(
        x["line_nos"].alias("o"), x["contents"].alias("t"), F.from_json(x["tools"], deltas).alias("d")))
    row = whole.select(key, part.alias("_parts"), "complete")
    sorted_of = lambda c: F.array_sort(F.transform(F.filter("_parts", lambda x: x[c].isNotNull()), lambda x: F.struct(x["o"], x[c])))
    row = row.select(key, "complete", sorted_of("t").alias("_t"), sorted_of("d").alias("_d"),
                     F.size(F.array_distinct(F.transform("_parts", lambda x: x["o"]))).cast("bigint").alias("n_lines"))
    row = row.select(key, "complete", "n_lines", first_of_each("_t").alias("_t"),
                     F.flatten(F.transform(first_of_each("_d"), lambda x: x["d"])).alias("_deltas"))
    return row.select(key, F.when(F.size("_t") > 0, F.array_join(F.transform("_t", lambda x: x["t"]), "")).alias("content"),
                      F.when(F.size("_deltas") > 0, F.to_json(merged_calls("_deltas"))).alias("tool_calls_json"),
                      "n_lines", "complete")
