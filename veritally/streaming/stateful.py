"""Streams that keep state of their own: rewritten slots, calls in flight.

Both need the RocksDB state store (``ROCKSDB`` in the session's settings),
which Spark's custom state requires.
"""

from __future__ import annotations

import pickle
import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..schema import SLOT

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
}

CHANGES = "model_name string, instance_index long, iteration int, is_safe boolean, category string, change int"


# Consecutive instances that share one entry of the state: reading and writing it costs more than what is in it.
INSTANCES = 64


class _LatestWrite(StatefulProcessor):
    """The latest writes of some slots; emits what a newer one takes back and puts in its place."""

    def __init__(self, keep_ms: int | None):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("slots", "packed binary")

    def _slots(self) -> dict:
        """(instance, iteration) -> (time, is_safe, category)."""
        packed = self.state.get()
        return pickle.loads(packed[0]) if packed is not None else {}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        slots, old = self._slots(), {}
        for part in rows:
            for instance, iteration, at, is_safe, category in zip(*(part[c].tolist() for c in ("instance_index", "iteration", "at", "is_safe", "category"))):
                slot = None if pd.isna(instance) else int(instance), None if pd.isna(iteration) else int(iteration)
                write = int(at), bool(is_safe), None if pd.isna(category) else str(category)
                known = slots.get(slot)
                # Equal times are decided by the columns, as in the batch form.
                if known is None or _order(write) > _order(known):
                    old.setdefault(slot, known)
                    slots[slot] = write
        if not old:
            return
        self._keep(slots)
        out = []
        for slot, before in old.items():
            after = slots[slot]
            if before is None or before[1:] != after[1:]:
                out += [(key[0], *slot, *before[1:], -1)] if before is not None else []
                out.append((key[0], *slot, *after[1:], 1))
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in CHANGES.split(", ")])

    def _keep(self, slots: dict) -> None:
        if not slots:
            self.state.clear()
            return
        self.state.update((pickle.dumps(slots, protocol=5),))
        if self.keep_ms is not None and not any(True for _ in self.handle.listTimers()):
            self.handle.registerTimer(min(w[0] for w in slots.values()) // 1000 + self.keep_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Slots that no write can reach any more are settled and leave the state."""
        passed = timerValues.getCurrentWatermarkInMs()
        self._keep({k: w for k, w in self._slots().items() if w[0] // 1000 + self.keep_ms > passed})
        return iter(())

    def close(self) -> None:
        pass


def _order(write: tuple) -> tuple:
    return write[0], write[1], write[2] is not None, write[2] or ""


def slot_changes(stream: DataFrame, settle: str | None = None, keep_seconds: int = 0) -> DataFrame:
    """Responses arriving on a stream to changes of the table of slots.

    The later write of a slot wins.  A first write is one row with ``change``
    1; a newer one that differs is a row with -1, the verdict that no longer
    holds, and a row with 1.  Sums of ``change`` are the counts of the batch
    ``dedupe_slots`` over all that has arrived.

    A slot's state is its latest write, kept with those of its neighbours.
    With ``settle``, a watermark delay, it is dropped ``keep_seconds`` of event
    time after that write, and writes that come later than the watermark are
    dropped by Spark; without, it is kept.
    """
    rows = stream.select(
        *SLOT, F.unix_micros(F.col("timestamp").cast("timestamp")).alias("at"), "is_safe", "category",
        F.col("timestamp").cast("timestamp").alias("timestamp"),
    )
    if settle is not None:
        rows = rows.withWatermark("timestamp", settle)
    near = F.coalesce(F.floor(F.col("instance_index") / INSTANCES), F.lit(0))
    return rows.withColumn("near", near).groupBy("model_name", "near").transformWithStateInPandas(
        statefulProcessor=_LatestWrite(keep_seconds * 1000 if settle is not None else None),
        outputStructType=CHANGES, outputMode="Update", timeMode="EventTime" if settle is not None else "None",
    )


def slot_counts(changes: DataFrame, by: Sequence[str] = ("model_name",)) -> DataFrame:
    """Slots, safe verdicts and slots per class now, from stored changes."""
    n = F.col("change")
    return changes.groupBy(*by, "category").agg(
        F.sum(n).alias("slots"), F.coalesce(F.sum(F.when(F.col("is_safe"), n)), F.lit(0)).alias("safe")
    ).where("slots <> 0")


BUCKET_US = 1_800_000_000


class _InFlight(StatefulProcessor):
    """Sweeps the starts and ends of calls as the watermark passes them."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # Steps not swept yet, (instant, step) pairs by half hour; calls running at the last swept instant; the highest number so far.
        self.steps = handle.getMapState("steps", "bucket long", "pairs binary")
        self.state = handle.getValueState("state", "running long, peak long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        at, step = [], []
        for part in rows:
            for column, change in (("start_us", 1), ("end_us", -1)):
                # An instant that has been swept already counts from the watermark on.
                at.append(np.maximum(part[column].to_numpy(np.int64), passed))
                step.append(np.full(len(part), change, np.int64))
        at, step = np.concatenate(at), np.concatenate(step)
        bucket = at // BUCKET_US
        order = np.argsort(bucket, kind="stable")
        first = np.flatnonzero(np.diff(bucket[order], prepend=bucket[order[0]] - 1))
        for own in np.split(order, first[1:]):
            self._put(int(bucket[own[0]]), at[own], step[own])
        if not any(True for _ in self.handle.listTimers()):
            self.handle.registerTimer(int(max(at.min(), passed)) // 1000 + 1)
        return iter(())

    def _put(self, bucket: int, at: np.ndarray, step: np.ndarray) -> None:
        if self.steps.containsKey((bucket,)):
            old = np.frombuffer(self.steps.getValue((bucket,))[0], np.int64).reshape(-1, 2)
            at, step = np.concatenate((old[:, 0], at)), np.concatenate((old[:, 1], step))
        at, where = np.unique(at, return_inverse=True)
        net = np.zeros(len(at), np.int64)
        np.add.at(net, where, step)
        self.steps.updateValue((bucket,), (np.stack((at, net), 1).tobytes(),))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        running, peak = tuple(self.state.get()) if self.state.exists() else (0, 0)
        before, buckets = peak, sorted(k[0] for k in self.steps.keys())
        for bucket in [b for b in buckets if b * BUCKET_US <= passed]:
            pairs = np.frombuffer(self.steps.getValue((bucket,))[0], np.int64).reshape(-1, 2)
            ready = pairs[:, 0] <= passed
            if ready.any():
                level = running + np.cumsum(pairs[ready, 1])
                running, peak = int(level[-1]), max(peak, int(level.max()))
            self.steps.removeKey((bucket,))
            if not ready.all():
                self._put(bucket, pairs[~ready, 0], pairs[~ready, 1])
        self.state.update((running, peak))
        left = [b for b in buckets if (b + 1) * BUCKET_US > passed]
        if left:
            self.handle.registerTimer(max(left[0] * BUCKET_US, passed) // 1000 + 1)
        return iter([pd.DataFrame([(*key, peak)], columns=["model_name", "peak_calls"])] if peak != before else [])

    def close(self) -> None:
        pass


def stream_peak_concurrency(stream: DataFrame, delay: str) -> DataFrame:
    """Most calls in flight at once per model, of all calls that the watermark has passed.

    Emits a model's number whenever it has grown.  State is the starts and
    ends that the watermark has not reached, added up per instant and kept by
    half hour, and two numbers; rows later than the watermark are dropped.  A call that is over before another starts at
    the same instant is not counted beside it, as in the batch form.
    """
    end = F.unix_micros("timestamp")
    rows = stream.select(
        "model_name", "latency", F.col("timestamp").cast("timestamp").alias("timestamp")
    ).withWatermark("timestamp", delay).select(
        "model_name", "timestamp", (end - F.round(F.col("latency") * 1000.0).cast("long")).alias("start_us"), end.alias("end_us")
    )
    return rows.groupBy("model_name").transformWithStateInPandas(
        statefulProcessor=_InFlight(), outputStructType="model_name string, peak_calls long",
        outputMode="Update", timeMode="EventTime",
    )
