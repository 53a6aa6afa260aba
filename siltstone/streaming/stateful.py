"""Machines that step through a key's rows in order of time, over tables and over streams.

A machine's state is small and plain (it is kept as JSON). Over a table, rows are dealt out by key and sorted within
tasks, and a task holds one key's state. Over a stream, a key's rows wait in its state until the watermark has passed
them, and are then taken in order of time, so that neither the order of arrival nor the cut into batches shows; rows
behind the watermark are dropped. What falls due without a further row is done by a timer. Both give the same rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: States and reasons of a key in the queue.
PENDING, RUNNING, COMPLETED, FAILED = "PENDING", "RUNNING", "COMPLETED", "FAILED"


class Machine:
    """What a key's rows do: `step` for each row, `expire` for what falls due at the time that `due` tells.

    Times are microseconds. `step` and `expire` return the new state and rows of `schema`; a state of None is forgotten."""

    schema = ""

    def step(self, state: Any, at: int, tie: Any, kind: str | None) -> tuple[Any, list[tuple]]:
        raise NotImplementedError

    def due(self, state: Any) -> int | None:
        return None

    def expire(self, state: Any) -> tuple[Any, list[tuple]]:
        return state, []

    def run(self, state: Any, rows: list[tuple], until: int | None) -> tuple[Any, list[tuple]]:
        """Rows (at, tie, kind) in order, and what falls due before each and up to `until` (None: for good)."""
        out: list[tuple] = []
        for row in rows:
            while (when := self.due(state)) is not None and when <= row[0]:
                state, more = self.expire(state)
                out += more
            state, more = self.step(state, *row)
            out += more
        while (when := self.due(state)) is not None and (until is None or when <= until):
            state, more = self.expire(state)
            out += more
        return state, out


@dataclass
class WorkQueue(Machine):
    """One request a key: asking again while it waits changes its reason and starts it over; while it runs, nothing.

    Kinds of rows: `claim`, `done`, `failed`; any other is a request for that reason. A run that failed, or that has not
    ended after `stalled` seconds, waits again until it was tried `attempts` times. What doesn't fit a state (to
    claim what doesn't wait, to end what doesn't run) says nothing. Each change gives a row."""

    attempts: int = 3
    stalled: float = 1800.0
    schema = "at timestamp, status string, attempts int, reason string"

    def _row(self, state: dict, at: int) -> list[tuple]:
        return [(at, state["status"], state["tries"], state["reason"])]

    def _failed(self, state: dict, at: int) -> tuple[dict, list[tuple]]:
        state = state | {"status": PENDING if state["tries"] < self.attempts else FAILED, "since": None}
        return state, self._row(state, at)

    def step(self, state: dict | None, at: int, tie: Any, kind: str | None) -> tuple[Any, list[tuple]]:
        status = state and state["status"]
        if kind == "claim":
            if status != PENDING:
                return state, []
            state = state | {"status": RUNNING, "tries": state["tries"] + 1, "since": at}
        elif kind in ("done", "failed"):
            if status != RUNNING:
                return state, []
            if kind == "failed":
                return self._failed(state, at)
            state = state | {"status": COMPLETED, "since": None}
        else:
            if status == RUNNING:
                return state, []
            state = {"status": PENDING, "tries": 0, "reason": kind, "since": None}
        return state, self._row(state, at)

    def due(self, state: dict | None) -> int | None:
        return state["since"] + int(self.stalled * 1e6) if state and state["status"] == RUNNING else None

    def expire(self, state: dict) -> tuple[dict, list[tuple]]:
        return self._failed(state, self.due(state))


@dataclass
class SlidingWindow(Machine):
    """Whether fewer than `most` rows were accepted in the `seconds` before each; refused ones don't count.

    A key whose last accepted row has left the window is forgotten."""

    most: int
    seconds: float
    schema = "tie long, accepted boolean"

    def step(self, state: list | None, at: int, tie: Any, kind: str | None) -> tuple[Any, list[tuple]]:
        taken = [t for t in state or [] if t > at - int(self.seconds * 1e6)]
        fine = len(taken) < self.most
        return taken + [at] * fine or None, [(tie, fine)]

    def due(self, state: list | None) -> int | None:
        return state[-1] + int(self.seconds * 1e6) if state else None

    def expire(self, state: list) -> tuple[None, list[tuple]]:
        return None, []


def _column(values: list, kind: T.DataType) -> pa.Array:
    if isinstance(kind, T.TimestampType):
        return pa.array(values, pa.timestamp("us", tz="UTC"))
    return pa.array(values, {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_()}[kind.simpleString()])


class _Processor(StatefulProcessor):
    """A key's machine on a stream; `waiting` holds rows that the watermark hasn't passed."""

    def __init__(self, machine: Machine, fields: list[T.StructField]):
        self.machine, self.fields = machine, fields

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "json string")
        self.waiting = handle.getListState("waiting", "at long, tie long, kind string")

    def _wake(self, micros: int) -> None:
        self.handle.registerTimer(-(-micros // 1000))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        least = None
        for part in rows:
            held = [(int(a), int(t), k) for a, t, k in zip(*(part.iloc[:, i] for i in (2, 3, 4)), strict=True)]
            self.waiting.appendList(held)
            least = min([a for a, _, _ in held] + ([] if least is None else [least]))
        if least is not None:
            self._wake(least)
        return iter([])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        held = sorted((tuple(r) for r in self.waiting.get()), key=lambda r: r[:2])
        ready, later = [r for r in held if r[0] <= now], [r for r in held if r[0] > now]
        state = json.loads(self.state.get()[0]) if self.state.exists() else None
        state, made = self.machine.run(state, ready, now)
        if later:
            self.waiting.put(later)
            self._wake(later[0][0])
        else:
            self.waiting.clear()
        if state is None:
            self.state.clear()
        else:
            self.state.update((json.dumps(state),))
            if (when := self.machine.due(state)) is not None:
                self._wake(when)
        if made:
            columns = list(zip(*[(key[0], *r) for r in made]))
            times = [isinstance(f.dataType, T.TimestampType) for f in self.fields]
            yield pd.DataFrame({f.name: pd.to_datetime(list(c), unit="us") if t else list(c) for f, c, t in zip(self.fields, columns, times)})

    def close(self) -> None:
        pass


def stepped(rows: DataFrame, key: str, at: str, tie: str, kind: str | None, machine: Machine, delay: str = "1 hour") -> DataFrame:
    """`key` and what `machine` says of the rows of each key in order of `at`, then `tie`, a whole number.

    Rows without a time say nothing. On a stream `delay` is how long rows may be late, and what falls due after the
    last watermark is yet to come; the session needs a state store that can hold lists and timers (RocksDB). Times
    of a stream are told apart by milliseconds where they wake a key. A null key is a key like others."""
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    schema = T.StructType([rows.schema[key], *T.StructType.fromDDL(machine.schema)])
    few = rows.where(F.col(at).isNotNull())
    if few.isStreaming:
        few = few.withWatermark(at, delay).select(F.col(key), F.col(at), micros.alias("__micros"), F.col(tie).cast("long").alias("__tie"), (F.col(kind) if kind else F.lit(None).cast("string")).alias("__kind"))
        return few.groupBy(key).transformWithStateInPandas(_Processor(machine, schema.fields), schema, "Append", "EventTime")
    few = few.select(key, micros.alias("__micros"), F.col(tie).cast("long").alias("__tie"), (F.col(kind) if kind else F.lit(None).cast("string")).alias("__kind"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Any = object()
        state: Any = None
        for batch in batches:
            places: list[int] = []
            out: list[tuple] = []
            ends: list[tuple] = []
            for i, (k, *row) in enumerate(zip(*(c.to_pylist() for c in batch.columns), strict=True)):
                if k != now:
                    ends += [(now, r) for r in machine.run(state, [], None)[1]]
                    now, state = k, None
                state, made = machine.run(state, [tuple(row)], row[0])
                places += [i] * len(made)
                out += made
            if ends:
                yield _batch([k for k, _ in ends], [r for _, r in ends])
            yield _batch(batch.column(0).take(pa.array(places, pa.int64())), out)
        rest = machine.run(state, [], None)[1]
        if rest:
            yield _batch([now] * len(rest), rest)

    def _batch(keys: Any, made: list[tuple]) -> pa.RecordBatch:
        keys = keys if isinstance(keys, pa.Array) else pa.array(keys)
        columns = [_column([r[i] for r in made], f.dataType) for i, f in enumerate(schema.fields[1:])]
        return pa.RecordBatch.from_arrays([keys, *columns], schema.names)

    return few.repartition(key).sortWithinPartitions(key, "__micros", "__tie").mapInArrow(run, schema)
