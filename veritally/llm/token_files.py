"""Token-id files: canonical length-limited Huffman code over all ids.

Code lengths come from the ids' counts over the whole corpus (package-merge),
so the code table is just one length per id.  Rows of the block table are
independent blocks of whole documents; within a block, a bit offset is kept
for every ``STRIDE`` ids.  Decoding looks up ``limit`` bits at a time and
advances from all checkpoints of a block at once.

The block table is Parquet: it is splittable, written and committed by Spark,
and needs no folder that executors reach outside Spark.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .common import IdCache, Shipped, ragged, slices, stored, string_bytes, worker_cache
from .text import span_keys

END = 0
LIMIT = 16
STRIDE = 64
# A block is closed after this many ids; a longer document is a block of its own.
BLOCK_IDS = 1 << 16
# Text pieces whose ids a worker remembers.
CACHE_PIECES = 1_500_000
# New pieces encoded in one call.
JOINED = 256


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths of an optimal prefix code of at most ``limit`` bits, 0 for
    counts of 0 (package-merge)."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids do not fit codes of {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weight = counts[order].astype(np.int64)
    level, leaves = weight, [np.ones(len(weight), bool)]
    for _ in range(limit - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate((weight, pairs))
        by = np.argsort(both, kind="stable")
        level = both[by]
        leaves.append(by < len(weight))
    take, length = 2 * len(weight) - 2, np.zeros(len(weight), np.int64)
    for leaf in reversed(leaves):
        n = int(leaf[:take].sum())
        length[:n] += 1
        take = 2 * (take - n)
    out[order] = length
    return out


class Code:
    """The canonical code of a length table: codes ascend by (length, id)."""

    def __init__(self, lengths: np.ndarray, limit: int = LIMIT):
        self.lengths, self.limit = lengths, limit
        used = np.flatnonzero(lengths)
        order = used[np.argsort(lengths[used], kind="stable")]
        size = np.int64(1) << (limit - lengths[order].astype(np.int64))
        first = np.concatenate(([0], np.cumsum(size)))
        self.codes = np.zeros(len(lengths), np.uint64)
        self.codes[order] = (first[:-1] >> (limit - lengths[order].astype(np.int64))).astype(np.uint64)
        self.symbols = np.zeros(1 << limit, np.uint32)
        self.steps = np.ones(1 << limit, np.uint8)
        self.symbols[: first[-1]] = np.repeat(order, size)
        self.steps[: first[-1]] = np.repeat(lengths[order], size)

    def encode(self, ids: np.ndarray) -> tuple[bytes, bytes]:
        """(bit stream, checkpoints: the bits of every STRIDE ids as 16-bit numbers)."""
        if not len(ids):
            return b"", b""
        length = self.lengths[ids].astype(np.int64)
        end = np.cumsum(length)
        start = end - length
        word, shift = start >> 5, start & 31
        wide = self.codes[ids] << (np.uint64(64) - (shift + length).astype(np.uint64))
        out = np.zeros(int(end[-1] + 31 >> 5) + 1, np.uint64)
        first = np.flatnonzero(np.diff(word, prepend=-1))
        out[word[first]] += np.add.reduceat(wide >> np.uint64(32), first)
        out[word[first] + 1] += np.add.reduceat(wide & np.uint64(0xFFFFFFFF), first)
        bits = out.astype(">u4").tobytes()[: int(end[-1] + 7 >> 3)]
        marks = start[::STRIDE]
        return bits, np.diff(marks, append=end[-1]).astype("<u2").tobytes()

    def decode(self, bits: bytes, marks: bytes, n: int) -> np.ndarray:
        out = np.zeros(n, np.uint32)
        if not n:
            return out
        data = np.concatenate((np.frombuffer(bits, np.uint8), np.zeros(8, np.uint8))).astype(np.uint32)
        size = np.frombuffer(marks, "<u2").astype(np.int64)
        at = np.cumsum(size) - size
        rows = np.arange(len(at)) * STRIDE
        for step in range(min(STRIDE, n)):
            if step and rows[-1] + step >= n:
                at, rows = at[:-1], rows[:-1]
            byte = at >> 3
            window = (data[byte] << 24) | (data[byte + 1] << 16) | (data[byte + 2] << 8) | data[byte + 3]
            place = (window << (at & 7).astype(np.uint32)) >> np.uint32(32 - self.limit)
            out[rows + step] = self.symbols[place]
            at = at + self.steps[place]
        return out


class Pieces:
    """Ids of text pieces through the tokenizers library, each piece once per worker.

    Texts are cut where the pre-tokenizer always cuts: before a single space
    and around a single line feed between other characters.
    """

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.known = IdCache(CACHE_PIECES)
        feed = self._encode(["\n"])[0]
        self.feed = feed[0] if len(feed) == 1 else None

    def _encode(self, texts: list[str]) -> list[list[int]]:
        encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        return [e.ids for e in encode(texts, add_special_tokens=False)]

    @staticmethod
    def of(vocabulary: str) -> Pieces:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        cache = worker_cache()
        if ("pieces", vocabulary) not in cache:
            cache[("pieces", vocabulary)] = Pieces(vocabulary)
        return cache[("pieces", vocabulary)]

    def _learn(self, keys: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """Encodes new pieces: most of them many at a time, with line feeds between.

        A line feed next to one space or none is always a token of its own,
        so the ids between two of them are those of one piece.
        """
        raw = data.tobytes()
        odd = np.concatenate(([0], np.cumsum((data <= 32) | (data == 0xC2) | ((data >= 0xE1) & (data <= 0xE3)))))
        plain = odd[ends] - odd[starts] == ((data[starts] == 32) & (ends - starts > 1))
        size, ids = np.zeros(len(keys), np.int64), []
        rows = np.flatnonzero(plain)
        for part in np.array_split(rows, -(-len(rows) // JOINED)) if len(rows) and self.feed is not None else []:
            text = b"\n".join(raw[a:b] for a, b in zip(starts[part].tolist(), ends[part].tolist()))
            got = np.array(self._encode([text.decode("utf-8", "replace")])[0], np.uint32)
            mark = np.flatnonzero(got == self.feed)
            if len(mark) != len(part) - 1:
                plain[part] = False
                continue
            size[part] = np.diff(mark, prepend=-1, append=len(got)) - 1
            ids.append(got[got != self.feed])
        if self.feed is None:
            plain[:] = False
        rest = np.flatnonzero(~plain)
        found = self._encode([raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[rest].tolist(), ends[rest].tolist())])
        size[rest] = [len(x) for x in found]
        ids += [np.array(x, np.uint32) for x in found]
        order = np.concatenate((np.flatnonzero(plain), rest))
        at = np.zeros(len(keys), np.int64)
        at[order] = np.cumsum(size[order]) - size[order]
        flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
        self.known.add(keys, size, flat[ragged(at, size)])

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, bounds per document), without end ids."""
        starts = _cuts(data, offsets)
        ends = np.append(starts[1:], len(data))
        keys, first, where = np.unique(span_keys(data, starts, ends), return_index=True, return_inverse=True)
        new = self.known.missing(keys)
        if len(new):
            self._learn(keys[new], data, starts[first[new]], ends[first[new]])
        ids, sizes = self.known.gather(keys, where)
        return ids, sizes[np.searchsorted(starts, offsets)]


def _cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of the pieces of every document."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    blank = data <= 32
    # White space outside ASCII is as good as a blank next to a cut.
    lead = np.flatnonzero((data == 0xC2) | ((data >= 0xE1) & (data <= 0xE3)))
    pad = np.concatenate((data, np.zeros(2, np.uint8)))
    for size, odd in ((2, (data[lead] == 0xC2) & np.isin(pad[lead + 1], (0x85, 0xA0))),
                      (3, (data[lead] != 0xC2) & np.isin(pad[lead + 1], (0x9A, 0x80, 0x81)))):
        for k in range(size):
            blank[np.minimum(lead[odd] + k, n - 1)] = True
    alone = np.zeros(n, bool)
    alone[1:-1] = blank[1:-1] & ~blank[:-2] & ~blank[2:]
    inner = offsets[(offsets > 0) & (offsets < n)]
    alone[inner] = alone[inner - 1] = False
    cut = alone & ((data == 32) | (data == 10))
    cut[1:] |= alone[:-1] & (data[:-1] == 10)
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    cut[first] = True
    return np.flatnonzero(cut)


ENCODED = "doc_id long, ids binary"


def _encode(vocabulary: str, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.of(vocabulary)
        for batch in batches:
            data, offsets = string_bytes(batch.column("text"))
            for a, b in slices(offsets, 1 << 21):
                own, bounds = pieces.encode(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                ids = np.full(len(own) + b - a, END, kind)
                inner = np.ones(len(ids), bool)
                inner[bounds[1:] + np.arange(b - a)] = False
                ids[inner] = own
                edges = ((bounds + np.arange(b - a + 1)) * ids.itemsize).astype(np.int32)
                blob = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(edges), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), blob], ["doc_id", "ids"])

    return run


class Encoded:
    """Written ids of every document, the end id included, in numbers as wide as the vocabulary needs."""

    def __init__(self, documents: DataFrame, vocabulary: str):
        from tokenizers import Tokenizer

        self.kind = "<u2" if Tokenizer.from_file(vocabulary).get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"
        self.rows = stored(documents.select("doc_id", "text").mapInArrow(_encode(vocabulary, self.kind), ENCODED), "ids")


def _count(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, np.int64)
        for batch in batches:
            raw, offsets = batch.column("ids").buffers()[2], np.frombuffer(batch.column("ids").buffers()[1], np.int32)
            first = batch.column("ids").offset
            ids = np.frombuffer(raw, np.uint8)[offsets[first] : offsets[first + batch.num_rows]].view(kind) if raw is not None else np.zeros(0, kind)
            own = np.bincount(ids, minlength=len(total))
            own[: len(total)] += total
            total = own
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["id", "n"])

    return run


def fit_ids(encoded: Encoded, limit: int = LIMIT) -> Code:
    """The code of all written ids.

    Counts are combined per task; at most the vocabulary reaches the driver.
    """
    counts = encoded.rows.select("ids").mapInArrow(_count(encoded.kind), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    table = np.zeros(max((r["id"] for r in counts), default=0) + 1, np.int64)
    for r in counts:
        table[r["id"]] = r["n"]
    return Code(code_lengths(table, limit), limit)


def fit(documents: DataFrame, vocabulary: str, limit: int = LIMIT) -> Code:
    """The code of all ids of ``documents(doc_id, text)`` and one end id per row."""
    return fit_ids(Encoded(documents, vocabulary), limit)


BLOCKS = "part int, block int, n_ids long, doc_ids binary, doc_sizes binary, marks binary, bits binary"


def _blocks(kind: str, shipped: Shipped):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, part = shipped.get(), TaskContext.get().partitionId()
        number, docs, sizes, held, n = 0, [], [], [], 0

        def close():
            nonlocal number, docs, sizes, held, n
            bits, marks = code.encode(np.concatenate(held))
            row = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([n], pa.int64()),
                 pa.array([np.array(docs, "<i8").tobytes()]), pa.array([np.array(sizes, "<i8").tobytes()]), pa.array([marks]), pa.array([bits])],
                ["part", "block", "n_ids", "doc_ids", "doc_sizes", "marks", "bits"],
            )
            number, docs, sizes, held, n = number + 1, [], [], [], 0
            return row

        for batch in batches:
            names, ids = batch.column("doc_id").fill_null(NO_ID).to_numpy(), batch.column("ids")
            for d in range(batch.num_rows):
                own = np.frombuffer(ids[d].as_buffer(), kind).astype(np.uint32)
                docs.append(names[d])
                sizes.append(len(own))
                held.append(own)
                n += len(own)
                if n >= BLOCK_IDS:
                    yield close()
        if docs:
            yield close()

    return run


NO_ID = -(1 << 63)


def write_ids(encoded: Encoded, code: Code) -> DataFrame:
    """Writes the block table of written ids in ascending doc_id order (rows
    of one doc_id by the number of their ids, then by a hash of them) and
    reads it back.

    Ranges of these three are spread over tasks, so rows that share a doc_id
    are not one task's; ``part`` and ``block`` number the blocks in order.
    """
    spark = encoded.rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = ["doc_id", "n", "tie"]
    rows = encoded.rows.withColumns({"n": F.octet_length("ids"), "tie": F.xxhash64("ids")})
    rows = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).select("doc_id", "ids")
    return stored(rows.mapInArrow(_blocks(encoded.kind, Shipped(spark, code)), BLOCKS), "blocks")


def write(documents: DataFrame, vocabulary: str, code: Code) -> DataFrame:
    """Writes the block table of ``documents(doc_id, text)``; NULL texts are
    empty, so their only id is the end id."""
    return write_ids(Encoded(documents, vocabulary), code)


def _read(shipped: Shipped, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = shipped.get()
        for batch in batches:
            for row in batch.to_pylist():
                ids = code.decode(row["bits"], row["marks"], row["n_ids"]).astype("<u4")
                sizes = np.frombuffer(row["doc_sizes"], "<i8")
                bounds = np.concatenate(([0], np.cumsum(sizes)))
                raw = ids.tobytes()
                crc = [zlib.crc32(raw[4 * bounds[d] : 4 * bounds[d + 1]]) for d in range(len(sizes))]
                docs = np.frombuffer(row["doc_ids"], "<i8")
                columns = {
                    "part": np.full(len(sizes), row["part"], np.int32), "block": np.full(len(sizes), row["block"], np.int32),
                    "doc_id": pa.array(docs, mask=docs == NO_ID), "at": bounds[:-1], "n_tokens": sizes, "ids_crc32": np.array(crc, np.int64),
                }
                if with_ids:
                    columns["ids"] = pa.array([ids[bounds[d] : bounds[d + 1]].astype(np.int32) for d in range(len(sizes))], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values()], list(columns))

    return run


def read(blocks: DataFrame, code: Code, with_ids: bool = False) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32[, ids])`` decoded from a block table.

    Blocks decode independently; only their sizes are summed in order.
    """
    more = ", ids array<int>" if with_ids else ""
    docs = blocks.mapInArrow(
        _read(Shipped(blocks.sparkSession, code), with_ids),
        f"part int, block int, doc_id long, at long, n_tokens long, ids_crc32 long{more}",
    )
    before = Window.unboundedPreceding, -1
    # One row per written part: as many as write tasks, not as rows.
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(*before)), F.lit(0)).alias("part_start")
    )
    starts = blocks.select(
        "part", "block",
        F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("block").rowsBetween(*before)), F.lit(0)).alias("block_start"),
    ).join(parts, "part")
    return docs.join(starts, ["part", "block"]).select(
        "doc_id", (F.col("part_start") + F.col("block_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32",
        *(["ids"] if with_ids else []),
    )


def token_files(documents: DataFrame, vocabulary: str) -> DataFrame:
    """Every text is tokenized once; the code and the blocks come from the written ids."""
    encoded = Encoded(documents, vocabulary)
    code = fit_ids(encoded)
    return read(write_ids(encoded, code), code)
