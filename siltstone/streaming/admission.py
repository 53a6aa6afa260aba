"""Admission over streams of events: sliding windows, spacing, and event-time roll-ups.

Whether an event is admitted depends on which earlier ones were, so frames can't express it. Rows are dealt out by
key and sorted within tasks; a task reads them in that order and holds the last accepted times of one key only. By the
rule itself all events of a key are read by one task, however many they are.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _stepped(rows: DataFrame, key: str, at: str, tie: str, result: str, kind: str, start: Callable[[], Callable[[int], object]]) -> DataFrame:
    """key, tie and what `start()`, made anew for each key, says of each of the key's times in turn.

    A null key is a key like others. Keys stay as they are: they aren't turned into floating numbers beside nulls."""
    few = rows.select(key, tie, F.unix_micros(F.col(at).cast("timestamp")).alias("__micros"))
    schema = T.StructType([rows.schema[key], rows.schema[tie], *T.StructType.fromDDL(f"{result} {kind}")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, step = object(), None
        for batch in batches:
            out = []
            for k, micros in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if k != now or step is None:
                    now, step = k, start()
                out.append(step(micros))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.bool_() if kind == "boolean" else pa.float64())], [key, tie, result])

    return few.repartition(key).sortWithinPartitions(key, "__micros", tie).mapInArrow(run, schema)


def sliding_window(rows: DataFrame, key: str, at: str, tie: str, most: int, seconds: float) -> DataFrame:
    """key, tie and accepted: fewer than `most` accepted in the trailing window. Refused events don't count.

    An event without a time is refused and counts for nothing."""
    width = int(seconds * 1e6)

    def start() -> Callable[[int], bool]:
        taken: deque[int] = deque()

        def admit(micros: int | None) -> bool:
            while taken and micros is not None and taken[0] <= micros - width:
                taken.popleft()
            fine = micros is not None and len(taken) < most
            if fine:
                taken.append(micros)
            return fine

        return admit

    return _stepped(rows, key, at, tie, "accepted", "boolean", start)


def spacing(rows: DataFrame, key: str, at: str, tie: str, seconds: float, patience: float) -> DataFrame:
    """key, tie and wait: the seconds until an event may start `seconds` after the one before; null if over `patience`,
    and for an event without a time."""
    gap, limit = int(seconds * 1e6), int(patience * 1e6)

    def start() -> Callable[[int], float | None]:
        free: list[int] = []

        def pace(micros: int | None) -> float | None:
            if micros is None:
                return None
            wait = max(0, free[0] - micros) if free else 0
            if wait <= limit:
                free[:] = [micros + wait + gap]
            return wait / 1e6 if wait <= limit else None

        return pace

    return _stepped(rows, key, at, tie, "wait", "double", start)


def idempotent(stream: DataFrame, key: list[str], at: str, delay: str) -> DataFrame:
    """Each key once within the watermark; works on streams, whose state it bounds, and on static rows."""
    if not stream.isStreaming:
        return stream.dropDuplicates(key)
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark(key)


def tumbling(stream: DataFrame, at: str, width: str, delay: str, *by: str) -> DataFrame:
    """Counts by window and columns; on a stream a window ends once the watermark has passed it."""
    rows = stream.withWatermark(at, delay) if stream.isStreaming else stream
    return rows.groupBy(F.window(at, width).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *by, "n")
