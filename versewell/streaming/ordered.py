"""Stateful folds in event-time order: rows wait in the state until the watermark has passed them.

Rows may come in any order and in any batches within the delay; the fold sees them by time, so its answers don't
depend on arrival. Rows later than the delay are dropped by the engine. A key's state holds the rows of the delay only,
and goes away ``idle`` after its last row where the fold says so.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any, NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

TICK_KEY = -(1 << 62)  # the key of rows that only move the watermark


class Row(NamedTuple):
    """What a step sees: seconds since 1970, the row's number (ties go by it), and its values."""

    at: float
    number: int
    values: list


def _plain(value: Any) -> Any:
    if value is None or isinstance(value, (bool, int, float, str)):
        return value
    return [_plain(v) for v in value] if hasattr(value, "__len__") else value.item()


def fold(rows: DataFrame, key: str, values: list[str], out: str, start: Any, step: Callable, delay: str = "1 day", idle: float | None = None, number: str = "event_id") -> DataFrame:
    """(answers) of ``step(key, state, row) -> (state, answers)`` over the rows of each key by ``at`` and ``number``.

    ``rows``: a stream with the key (a whole number), ``at`` and ``number``; ``values``: the columns that a step reads.
    ``start`` and every state are plain JSON values.
    """
    names = [c.split()[0] for c in out.split(", ")]

    def run(k: tuple, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state, waiting, last = json.loads(held.get[0]) if held.exists else (start, [], None)
        if not held.hasTimedOut:
            for part in parts:
                micros = part["at"].astype("datetime64[us]").astype("int64")
                waiting += [[int(t), int(n), *map(_plain, v)] for t, n, *v in zip(micros, part[number], *(part[c] for c in values))]
        waiting.sort(key=lambda r: r[:2])
        mark, said, done = held.getCurrentWatermarkMs() * 1000, [], 0
        while done < len(waiting) and waiting[done][0] <= mark:
            at, n, *v = waiting[done]
            state, answers = step(k[0], state, Row(at / 1e6, n, v))
            said += answers
            last, done = at, done + 1
        waiting = waiting[done:]
        if not waiting and idle is not None and last is not None and mark >= last + idle * 1e6:
            held.remove()
        else:
            held.update((json.dumps([state, waiting, last]),))
            wake = waiting[0][0] // 1000 if waiting else None if idle is None or last is None else int(last // 1000 + idle * 1000)
            if wake is not None:
                held.setTimeoutTimestamp(max(wake, mark // 1000 + 1))
        yield pd.DataFrame(said, columns=names)

    seen = rows.withWatermark("at", delay).select(key, "at", number, *values)
    return seen.groupBy(key).applyInPandasWithState(run, out, "held string", "append", GroupStateTimeout.EventTimeTimeout)


def with_ticks(rows: DataFrame, folder: str) -> tuple[DataFrame, Callable[[Any], None]]:
    """The stream with another one beside it, and what to call to let time pass there: everything up to the given moment
    is then folded. Live streams need no ticks."""
    spark, kind = rows.sparkSession, T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema])
    spark.createDataFrame([], kind).write.mode("ignore").parquet(folder)
    ticks = spark.readStream.schema(kind).parquet(folder)

    def tick(at: Any) -> None:
        one = [TICK_KEY if k == 0 else at if f.name == "at" else 0 if f.dataType.typeName() in ("long", "integer") else None for k, f in enumerate(kind)]
        spark.createDataFrame([tuple(one)], kind).coalesce(1).write.mode("append").parquet(folder)

    return rows.unionByName(ticks), tick
