"""Small helpers shared by the operators: written intermediates, worker
caches, Arrow text columns and sorted hash tables."""

from __future__ import annotations

import pickle
import sys
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..plans.shared import scratch_path

# Text bytes handled at once inside a task; one longer document is a slice of its own.
SLICE_BYTES = 1 << 20


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the session's shared folder and read back.

    Cuts the lineage; a lost executor costs only the tasks it was running.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def narrow_batches(spark: SparkSession, rows: int = 2_000) -> None:
    """Arrow batches of texts stay small: they exist on both sides of the pipe at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))
    # Where the session knows the setting, long texts count by their bytes.
    if spark.conf.isModifiable(BATCH_BYTES):
        spark.conf.set(BATCH_BYTES, str(8 << 20))


def crc_mod(column: str, k: int) -> Column:
    """crc32 of the column as text, modulo ``k`` (NULL counts as empty text)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % k


def unit_hash(*columns: str, salt: str) -> Column:
    """A repeatable number in [0, 1) for a row's key."""
    return F.pmod(F.xxhash64(F.lit(salt), *columns), F.lit(1 << 30)) / float(1 << 30)


def worker_cache() -> dict:
    """A dictionary that lives as long as the Python worker process."""
    return sys.__dict__.setdefault("_veritally_llm_cache", {})


class Shipped:
    """A value sent once to every executor; its classes travel with it and
    each Python worker unpacks the newest one only."""

    def __init__(self, spark: SparkSession, value):
        self.token = uuid.uuid4().hex
        self.packed = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    def get(self):
        cache = worker_cache()
        if cache.get("shipped", (None,))[0] != self.token:
            cache.pop("pieces", None)
            cache["shipped"] = self.token, pickle.loads(self.packed.value)
        return cache["shipped"][1]


def release() -> None:
    """Drops what earlier operators keep in a Python worker that is used again."""
    cache = worker_cache()
    for key in [k for k in cache if k != "letters"]:
        del cache[key]


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its n + 1 offsets; NULL is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows whose texts hold about ``limit`` bytes together."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1, at + 1)
        yield at, to
        at = to


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective finishing step that spreads all input bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """1, base, base^2, ... modulo 2^64, kept per worker and grown on demand."""
    cache = worker_cache()
    have = cache.get(("powers", base))
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        step = np.full(size, base, np.uint64)
        step[0] = 1
        have = np.multiply.accumulate(step)
        if size <= 8 * SLICE_BYTES:
            cache[("powers", base)] = have
    return have[:n]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of every run, one after the other."""
    total = int(lengths.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    shift = starts - np.concatenate(([0], np.cumsum(lengths)[:-1]))
    return np.arange(total, dtype=np.int64) + np.repeat(shift, lengths)


def run_sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums over consecutive runs given by their n + 1 bounds; empty runs give 0."""
    total = np.concatenate((np.zeros((1,) + values.shape[1:], values.dtype), np.cumsum(values, axis=0)))
    return total[ends[1:]] - total[ends[:-1]]


class HashTable:
    """Sorted 64-bit hashes; a start index over the top bits replaces most of
    the binary search."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = max(1, min(24, int(len(keys)).bit_length() + 1))
        edges = np.arange((1 << self.bits) + 1, dtype=np.float64) * float(2 ** (64 - self.bits))
        edges[-1] = 0
        self.start = np.searchsorted(keys, edges.astype(np.uint64)).astype(np.int64)
        self.start[-1] = len(keys)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Position of every hash, -1 where it is absent."""
        out = np.full(len(h), -1, np.int64)
        if not len(self.keys) or not len(h):
            return out
        top = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        at, end = self.start[top], self.start[top + 1]
        left = np.flatnonzero(at < end)
        while len(left):
            p, want = at[left], h[left]
            got = self.keys[p]
            hit = got == want
            out[left[hit]] = p[hit]
            on = got < want
            left = left[on]
            at[left] += 1
            left = left[at[left] < end[left]]
        return out


class IdCache:
    """Ids of text pieces by the pieces' hashes, in growing flat arrays."""

    def __init__(self, limit: int):
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.keys, self.at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0

    def missing(self, keys: np.ndarray) -> np.ndarray:
        """Positions of the sorted ``keys`` that are new; starts afresh at the limit."""
        if len(self.keys) + len(keys) > self.limit:
            self.clear()
        place = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = place < len(self.keys)
        known[inside] = self.keys[place[inside]] == keys[inside]
        return np.flatnonzero(~known)

    def add(self, keys: np.ndarray, size: np.ndarray, flat: np.ndarray) -> None:
        if self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros(max(len(flat), len(self.ids)), np.uint32)))
        self.ids[self.used : self.used + len(flat)] = flat
        at = self.used + np.cumsum(size) - size
        self.used += len(flat)
        place = np.searchsorted(self.keys, keys)
        self.keys, self.at, self.size = np.insert(self.keys, place, keys), np.insert(self.at, place, at), np.insert(self.size, place, size)

    def gather(self, keys: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the pieces ``keys[where]`` one after the other, bounds per piece)."""
        at = np.searchsorted(self.keys, keys)[where] if len(keys) else np.zeros(0, np.int64)
        size = self.size[at]
        return self.ids[ragged(self.at[at], size)], np.concatenate(([0], np.cumsum(size)))
