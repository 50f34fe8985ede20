"""Packing of tokenized documents into sequences of a fixed number of tokens.

A sequence holds at most two pieces over a third of its capacity, so those are
paired first: from the longest down, each with the longest partner that still
fits, which gives as many pairs as there can be.  The other pieces go, longest
first, into the smallest gap that holds them, or into a new sequence.

Pieces of one length are alike, so all this is done on the counts per length:
at most ``capacity`` numbers reach the driver, whatever the corpus.  Its answer
says which ranks of a length go where; a gap that takes pieces keeps less than
half of itself, so there are fewer than ``log2(capacity)`` answers for every
kind of sequence, and kinds are made by lengths alone.  A piece's rank within
its length is its place in the task that cut it plus the counts of the tasks
before.

Odd cases: NULL or empty texts have the end id only; NULL and repeated doc_ids
and repeated rows are packed like all others; an empty table has no pieces.
Other columns are ignored.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .common import IdCache, Shipped, ragged, slices, stored, string_bytes, worker_cache
from .text import is_space, run_bounds, span_keys

CAPACITY = 2048
END = 0
# Words whose ids a worker remembers.
CACHE_WORDS = 500_000
# New words encoded in one call.
JOINED = 256

PIECES = "doc_id long, piece int, start long, length int, ids binary, part int, nth long"


class Words:
    """Ids of words through the tokenizers library, each word once per worker.

    For vocabularies that drop white space: no token and no normalisation
    reaches across it, so a text's ids are those of its words.
    """

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.known = IdCache(CACHE_WORDS)
        [self.bar] = self.tokenizer.encode("|", add_special_tokens=False).ids

    @staticmethod
    def of(vocabulary: str) -> Words:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        cache = worker_cache()
        if ("words", vocabulary) not in cache:
            cache[("words", vocabulary)] = Words(vocabulary)
        return cache[("words", vocabulary)]

    def _learn(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids of new words, most of them many to a call.

        A bar between spaces is a token of its own, which no word without a
        bar has, so the ids between two bars are those of one word.
        """
        plain = np.array([b"|" not in w for w in words])
        size, ids = np.zeros(len(words), np.int64), [None] * len(words)
        rows = np.flatnonzero(plain)
        parts = np.array_split(rows, -(-len(rows) // JOINED)) if len(rows) else []
        texts = [b" | ".join([words[i] for i in part.tolist()]).decode("utf-8", "replace") for part in parts]
        for part, e in zip(parts, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            got = np.array(e.ids, np.uint32)
            marks = np.flatnonzero(got == self.bar)
            size[part] = np.diff(marks, prepend=-1, append=len(got)) - 1
            ids[part[0]] = got[got != self.bar]
        for i in np.flatnonzero(~plain).tolist():
            ids[i] = np.array(self.tokenizer.encode(words[i].decode("utf-8", "replace"), add_special_tokens=False).ids, np.uint32)
            size[i] = len(ids[i])
        order = np.concatenate((rows, np.flatnonzero(~plain)))
        flat = np.concatenate([ids[part[0]] for part in parts] + [ids[i] for i in np.flatnonzero(~plain).tolist()])
        at = np.zeros(len(words), np.int64)
        at[order] = np.cumsum(size[order]) - size[order]
        return size, flat[ragged(at, size)]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, bounds per document), without end ids."""
        data, starts, ends = _pieces(data, offsets)
        keys, first, where = np.unique(span_keys(data, starts, ends), return_index=True, return_inverse=True)
        new = self.known.missing(keys)
        if len(new):
            raw, at = data.tobytes(), first[new]
            words = [raw[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist())]
            size, flat = self._learn(words)
            self.known.add(keys[new], size, flat)
        ids, bounds = self.known.gather(keys, where)
        return ids, bounds[np.searchsorted(starts, offsets)]


# Bytes that never share a token or a composed character with an ASCII letter before or after them.
_MARKS = np.zeros(256, bool)
_MARKS[[ord(c) for c in "!\"#$%&()*+,-./:;=?@[\\]^_`{}~"]] = True
_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(65, 91), *range(97, 123)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(A-Z lowered, starts, ends): words, cut between a letter and a mark.

    Special tokens, which are looked for before letters are lowered, have a bar
    in them, so words with a bar stay as they are.
    """
    starts, ends = run_bounds(~is_space(data), offsets)
    lowered = _LOWER[data]
    bars = np.flatnonzero(data == ord("|"))
    if len(bars):
        odd = np.unique(np.searchsorted(starts, bars, "right") - 1)
        own = ragged(starts[odd], ends[odd] - starts[odd])
        lowered[own] = data[own]
    letter, mark = _LETTERS[data], _MARKS[data]
    inner = np.flatnonzero((letter[:-1] & mark[1:]) | (mark[:-1] & letter[1:])) + 1
    begins, stops = np.zeros(len(data) + 1, bool), np.zeros(len(data) + 1, bool)
    begins[starts] = begins[inner] = stops[ends] = stops[inner] = True
    return lowered, np.flatnonzero(begins), np.flatnonzero(stops)


def _places(lengths: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """How many pieces of the same length came before each, ``seen`` ones included."""
    order = np.argsort(lengths, kind="stable")
    ordered = lengths[order]
    first = np.flatnonzero(np.diff(ordered, prepend=-1))
    size = np.diff(first, append=len(ordered))
    out = np.empty(len(lengths), np.int64)
    out[order] = np.arange(len(lengths)) - np.repeat(first, size) + seen[ordered]
    seen[ordered[first]] += size
    return out


def _cut(vocabulary: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, seen = Words.of(vocabulary), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            data, offsets = string_bytes(batch.column("text"))
            for a, b in slices(offsets, 1 << 21):
                own, bounds = words.encode(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                size = np.diff(bounds) + 1
                ids = np.full(int(size.sum()), END, "<u4")
                inner = np.ones(len(ids), bool)
                inner[np.cumsum(size) - 1] = False
                ids[inner] = own
                n = -(-size // capacity)
                doc = np.repeat(np.arange(b - a), n)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                length = np.minimum(capacity, size[doc] - piece * capacity)
                edges = np.concatenate(([0], np.cumsum(length * 4))).astype(np.int32)
                blob = pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(edges), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(a + doc)), pa.array(piece, pa.int32()), pa.array(piece * capacity, pa.int64()),
                     pa.array(length, pa.int32()), blob, pa.array(np.full(len(doc), part), pa.int32()), pa.array(_places(length, seen))],
                    ["doc_id", "piece", "start", "length", "ids", "part", "nth"],
                )

    return run


def cut(documents: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """Writes the pieces of ``documents(doc_id, text)``: ids as little-endian
    unsigned 32-bit numbers, the writing task and the place among its pieces of
    the same length."""
    return stored(documents.select("doc_id", "text").mapInArrow(_cut(vocabulary, capacity), PIECES), "pieces")


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Where the pieces of every length go, from the number of pieces per length.

    Rows are ``(length, rank, sequence, per, offset)``: from that rank on, up to
    the next row of the length, ``per`` pieces after one another go into each
    sequence from ``sequence`` on, beginning at ``offset``.
    """
    left, rank = counts.astype(np.int64).copy(), np.zeros(capacity + 1, np.int64)
    gaps: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
    rows, opened = [], 0

    def put(length: int, n: int, sequence: int, per: int, offset: int) -> None:
        rows.append((length, rank[length], sequence, per, offset))
        rank[length] += n
        left[length] -= n

    third = capacity // 3
    for length in range(capacity, third, -1):
        partner = min(length, capacity - length)
        while left[length]:
            while partner > third and left[partner] < (2 if partner == length else 1):
                partner -= 1
            if partner <= third:
                n, used = int(left[length]), length
                put(length, n, opened, 1, 0)
            elif partner == length:
                n, used = int(left[length]) // 2, 2 * length
                put(length, 2 * n, opened, 2, 0)
            else:
                n, used = int(min(left[length], left[partner])), length + partner
                put(length, n, opened, 1, 0)
                put(partner, n, opened, 1, length)
            gaps[capacity - used].append((opened, n))
            opened += n
    for length in range(third, 0, -1):
        gap = length
        while left[length]:
            while gap <= capacity and not gaps[gap]:
                gap += 1
            if gap > capacity:
                n = -(-int(left[length]) // (capacity // length))
                gaps[capacity].append((opened, n))
                opened, gap = opened + n, capacity
            first, n = gaps[gap].pop()
            per = gap // length
            full, rest = divmod(int(min(left[length], n * per)), per)
            put(length, full * per + rest, first, per, capacity - gap)
            for at, many, taken in ((first, full, per), (first + full, int(rest > 0), rest), (first + full + (rest > 0), n - full - (rest > 0), 0)):
                if many:
                    gaps[gap - taken * length].append((at, many))
    out = np.array(rows, np.int64).reshape(-1, 5)
    return out[np.lexsort((out[:, 1], out[:, 0]))]


RANK = np.int64(1) << 50


def _place(shipped: Shipped, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, first, sequence, per, offset = shipped.get().T
        keys = length * RANK + first
        for batch in batches:
            own, rank = (batch.column(c).to_numpy().astype(np.int64) for c in ("length", "rank"))
            at = np.searchsorted(keys, own * RANK + rank, "right") - 1
            turn, place = np.divmod(rank - first[at], per[at])
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in names] + [pa.array(sequence[at] + turn), pa.array(offset[at] + place * own)],
                [*names, "sequence_id", "offset"],
            )

    return run


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to a table of pieces with ``length, part, nth``."""
    per_task = stored(pieces.groupBy(F.col("part").alias("of"), F.col("length").alias("own")).agg(F.count(F.lit(1)).alias("n")), "lengths")
    counts = np.zeros(capacity + 1, np.int64)
    for r in per_task.groupBy("own").agg(F.sum("n").alias("n")).collect():
        counts[r["own"]] = r["n"]
    earlier = Window.partitionBy("own").orderBy("of").rowsBetween(Window.unboundedPreceding, -1)
    before = per_task.select("of", "own", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    names = [c for c in pieces.columns if c not in ("part", "nth")]
    rows = pieces.join(before, (F.col("part") == F.col("of")) & (F.col("length") == F.col("own"))).select(
        *names, (F.col("before") + F.col("nth")).alias("rank")
    )
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema if f.name in names)
    return rows.mapInArrow(
        _place(Shipped(pieces.sparkSession, plan(counts, capacity)), names), f"{schema}, sequence_id long, offset long"
    )


def pack(documents: DataFrame, vocabulary: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset`` of every piece."""
    pieces = cut(documents, vocabulary, capacity)
    return place(
        pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), *(["ids"] if with_ids else []), "part", "nth"),
        capacity,
    ).withColumn("length", F.col("length").cast("long"))


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, n_tokens, ids`` of pieces packed with their ids.

    A sequence is at most ``capacity`` ids, so no group is large.
    """
    inside = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(
        F.sum("length").alias("n_tokens"),
        F.aggregate(inside, F.lit(b""), lambda acc, x: F.concat(acc, x["ids"])).alias("ids"),
    )
