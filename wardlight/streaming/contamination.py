"""Contamination levels over a stream of toilet events, in event-time order."""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from wardlight.operators import hospital
from wardlight.operators.hospital import CLEANING_EFFECT
from wardlight.session import materialize

# workers get the processor itself, so they need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Times cross into Python as microseconds since the epoch: pandas would get them in the session's local time, while
# watermarks are in epoch milliseconds.
OUTPUT = "toilet_id long, event_id long, micros long, level_before double, level_after double"
_WAITING = "micros bigint, event_id bigint, clean boolean, added double"
BUCKET_MS = 600_000
CHUNK = 256


def replay_levels(start: float, clean: np.ndarray, added: np.ndarray, effect: float) -> np.ndarray:
    """The level after each event from ``start`` on: the level over the product of all that cleanings leave is a running sum held below a running minimum.

    Chunks are short enough for that product to stay a double; only chunks are followed one by one.
    """
    keep = 1.0 - min(effect, 1.0 - 1e-12)
    rows = max(1, min(CHUNK, int(250 / -math.log10(keep)))) if keep < 1.0 else CHUNK
    after = np.empty(len(clean))
    for i in range(0, len(clean), rows):
        left = keep ** np.cumsum(clean[i:i + rows])
        grown = np.cumsum(added[i:i + rows] / left)
        after[i:i + rows] = left * (grown + np.minimum(start, np.minimum.accumulate(1.0 / left - grown)))
        start = after[min(i + rows, len(clean)) - 1]
    return after


class ContaminationReplay(StatefulProcessor):
    """Per toilet: the current level, the events of the time buckets that the watermark has not passed, and one timer, for the earliest of these buckets.

    The new events of a micro-batch are added in one call. When the watermark has passed a bucket, the events of all buckets that it has passed are applied in ``(ts, event_id)``
    order at once, so the calls to the state grow with toilets and passes of the watermark, not with events; rows out of order within the
    watermark are handled, rows of a bucket that is done are dropped.
    """

    def __init__(self, effect: float = CLEANING_EFFECT, bucket_ms: int = BUCKET_MS) -> None:
        self._effect, self._bucket = effect, bucket_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._level = handle.getValueState("level", "level double")
        self._waiting = handle.getListState("waiting", _WAITING)
        self._due = handle.getValueState("due", "ms bigint")

    def _ends(self, micros: np.ndarray) -> np.ndarray:
        """Milliseconds at which the bucket of each event ends."""
        return (micros // (1000 * self._bucket) + 1) * self._bucket

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        watermark, first = timerValues.getCurrentWatermarkInMs(), None
        for pdf in rows:
            ends = self._ends(pdf["micros"].to_numpy())
            fresh = ends > watermark
            if not fresh.any():
                continue
            part = pdf[fresh]
            adds = np.where((part["kind"] == "use") & part["colonised"].astype(bool), part["amount"], 0.0)
            self._waiting.appendList(list(zip(part["micros"].tolist(), part["event_id"].tolist(), (part["kind"] == "clean").tolist(), adds.tolist(), strict=True)))
            end = int(ends[fresh].min())
            first = end if first is None else min(first, end)
        if first is not None:
            self._wake(first - 1)
        return iter([])

    def _wake(self, at: int) -> None:
        due = self._due.get()[0] if self._due.exists() else None
        if due is None or at < due:
            if due is not None:
                self._handle.deleteTimer(due)
            self._handle.registerTimer(at)
            self._due.update((at,))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        micros, event_id, clean, added = (np.array(x) for x in zip(*self._waiting.get(), strict=True))
        ends = self._ends(micros)
        done = ends <= max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs() + 1)
        left = ~done
        self._due.clear()
        if left.any():
            self._waiting.put(list(zip(micros[left].tolist(), event_id[left].tolist(), clean[left].tolist(), added[left].tolist(), strict=True)))
            self._wake(int(ends[left].min()) - 1)
        else:
            self._waiting.clear()
        micros, event_id, clean, added = (x[done] for x in (micros, event_id, clean, added))
        order = np.lexsort((event_id, micros))
        start = self._level.get()[0] if self._level.exists() else 0.0
        after = replay_levels(start, clean[order].astype(bool), added[order], self._effect)
        self._level.update((float(after[-1]),))
        out = {"toilet_id": key[0], "event_id": event_id[order], "micros": micros[order], "level_before": np.concatenate(([start], after[:-1])), "level_after": after}
        return iter([pd.DataFrame(out)])

    def close(self) -> None:
        pass


def contamination_stream(events: DataFrame, delay: str = "1 hour", effect: float = CLEANING_EFFECT, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """Levels of a stream of toilet events (append mode, event time ``ts``), a time bucket at a time once the watermark is past it."""
    timed = events.withWatermark("ts", delay).withColumn("micros", F.unix_micros("ts"))
    levels = timed.groupBy("toilet_id").transformWithStateInPandas(
        statefulProcessor=ContaminationReplay(effect, bucket_ms), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime"
    )
    return levels.select("toilet_id", "event_id", F.timestamp_micros("micros").alias("ts"), "level_before", "level_after")


def closing_levels(events: DataFrame, emitted: DataFrame, delay: str = "1 hour", effect: float = CLEANING_EFFECT, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """Levels of the events that still waited when the stream ended, as a batch: from the level that the stream left each toilet with.

    ``events``: all events that the stream was given; ``emitted``: what it wrote. Rows that the stream dropped because their bucket was done stay dropped.
    """
    last = events.agg(F.max("ts").alias("ts")).select(F.unix_millis(F.col("ts") - F.expr(f"INTERVAL {delay}")).alias("ms")).scalar()
    done = F.floor(last / F.lit(bucket_ms)) * bucket_ms
    waiting = events.filter(F.unix_millis("ts") >= done).join(emitted.select("toilet_id", "event_id"), ["toilet_id", "event_id"], "left_anti").select(events.columns)
    starts = materialize(emitted.groupBy("toilet_id").agg(F.max_by("level_after", F.struct("ts", "event_id")).alias("level")), "stream-levels")
    return hospital.contamination_levels(waiting, effect, starts=starts).select("toilet_id", "event_id", "ts", "level_before", "level_after")
