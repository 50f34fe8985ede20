"""Language-model scoring by deleted interpolation.

The probability of a word after a word mixes the bigram's and the word's
maximum-likelihood estimates with a uniform one.  The mixture weights depend
on how often the context was seen; they are learned by
expectation-maximisation on deleted counts: every training token is predicted
from the counts without itself.

* Word counts of the whole training part are one aggregation.  The most
  frequent words, at most ``DICTIONARY``, go to the tasks; bigrams that end in
  another word are joined with the counts of those by the word.
* Bigrams of all documents meet by context in one exchange of packed arrays:
  the training ones are counted there and all are looked up there.  Frequent
  contexts are split by the following word, since their counts are known.
  A bigram of two dictionary words is one number.
* What is looked up is written, the weights are learned from its histogram,
  and a last exchange sums log-probabilities per document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from .common import HashTable, Shipped, crc_mod, mix64, narrow_batches, run_sums, slices, stored, string_bytes
from .text import words

DICTIONARY = 1 << 18
# Tokens a task holds before it sends them, and tokens to an exchange partition.  With more than DENSE_PARTS
# partitions it holds as many times more, up to MOST_HOLD, so that what goes to one partition at once stays long.
HOLD_TOKENS = 1 << 18
PART_TOKENS = 1 << 20
DENSE_PARTS, MOST_HOLD = 512, 8
BATCH_ROWS = 256
CHUNK = 1 << 17  # bigrams that are brought into the order of documents, or summed, at once
# Two words and a document's number in its flush share 64 bits.
MOST_WORDS = 1 << 22
# Contexts are told apart by the logarithm of their frequency.
CLASSES = 24
EM_STEPS = 40
SCALE = 1024  # fixed-point steps of a probability's binary logarithm: 16 bits reach 2^-64
ABSENT = 65535
END, START = np.uint64(0x1), np.uint64(0x2)
TAIL = np.uint64(1 << 63)


@dataclass
class Counts:
    """Figures of the training tokens that every task needs."""

    hashes: np.ndarray  # sorted, of the dictionary
    counts: np.ndarray
    documents: int
    tokens: int
    kinds: int
    hapaxes: int
    parts: int
    _table: HashTable | None = field(default=None)
    _by_key: KeyFigures | None = field(default=None)

    def table(self) -> HashTable:
        if self._table is None:
            self._table = HashTable(self.hashes)
        return self._table

    def by_key(self) -> KeyFigures:
        if self._by_key is None:
            self._by_key = KeyFigures(self)
        return self._by_key

    def bits(self) -> int:
        """Of a key of START, END or a word of the dictionary."""
        return (len(self.hashes) + 8).bit_length()

    def hold(self) -> int:
        return HOLD_TOKENS * min(max(1, -(-self.parts // DENSE_PARTS)), MOST_HOLD)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.5) / (self.tokens + 0.5 * (self.kinds + 1)))

    def uniform(self) -> float:
        return 1.0 / (self.kinds + self.hapaxes + 1)


class KeyFigures:
    """What depends on a small key alone, by key."""

    def __init__(self, c: Counts):
        keys = np.arange(len(c.counts) + 8, dtype=np.uint64)
        self.seen, ends = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        self.seen[8:] = ends[8:] = c.counts
        self.seen[int(START)] = ends[int(END)] = c.documents
        self.klass = _class(self.seen)
        share = ends / max(c.tokens, 1)
        self.word = _fixed(share).astype("<u2")
        self.deleted = _fixed(np.maximum(share - 1.0 / max(c.tokens, 1), 0)) * 8 // SCALE
        self.base = np.append(c.base(c.counts), 0.0)  # by place; at -1 that of words outside the dictionary, added later
        # A context's share of all tokens, in exchange partitions, says into how many pieces it is split.
        self.pieces = np.maximum(np.ceil(16.0 * self.seen * c.parts / max(c.tokens, 1)), 1).astype(np.uint64)
        self.home, self.mixed = mix64(keys * np.uint64(3)), mix64(keys)


def _class(seen: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(seen + 1.0).astype(np.int64), CLASSES - 1)


def _parts(c: Counts, home: np.ndarray, pieces: np.ndarray, mixed: np.ndarray) -> np.ndarray:
    """Exchange partitions of bigrams: by context, and by follower too where a context is split."""
    split = np.flatnonzero(pieces > 1)
    home[split] += mixed[split] % pieces[split] * np.uint64(0x9E3779B97F4A7C15)
    return ((mix64(home) >> np.uint64(33)) % np.uint64(c.parts)).astype(np.uint16 if c.parts <= 1 << 16 else np.uint32)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def send():
        h, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["h", "n"])

    for batch in batches:
        data, offsets = string_bytes(batch.column("text"))
        for a, b in slices(offsets, 1 << 20):
            h, _, _ = words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            held.append(h)
            size += len(h)
            if size >= 4 * HOLD_TOKENS:
                yield send()
                held, size = [], 0
    if size:
        yield send()


def fit_counts(training: DataFrame, dictionary: int = DICTIONARY) -> tuple[Counts, DataFrame]:
    """Counts over all words of ``training(text)``, one end token per row, and
    ``(w, c)``, the counts of the words that are not in the dictionary."""
    spark = training.sparkSession
    table = stored(training.select("text").mapInArrow(_count_words, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "words")
    total = table.agg(F.sum("n").alias("n"), F.count("*").alias("v"), F.count(F.when(F.col("n") == 1, 1)).alias("once")).first()
    # The least count at which the words fit into the dictionary, by eighths of a power of two.
    step = F.floor(F.log2("n") * 8)
    least = None
    room = min(dictionary, MOST_WORDS)
    for r in table.groupBy(step.alias("step")).agg(F.count("*").alias("k")).orderBy(F.desc("step")).collect():
        room -= r["k"]
        if room < 0:
            break
        least = r["step"]
    listed = table.where(step >= least).toPandas() if least is not None else None
    h = listed["h"].to_numpy(np.int64).view(np.uint64) if listed is not None else np.zeros(0, np.uint64)
    n = listed["n"].to_numpy(np.int64) if listed is not None else np.zeros(0, np.int64)
    order = np.argsort(h)
    docs = training.count()
    tokens = int(total["n"] or 0) + docs
    parts = max(2 * spark.sparkContext.defaultParallelism, tokens // PART_TOKENS)
    others = (table if least is None else table.where(step < least)).select(F.col("h").bitwiseOR(F.lit(TAIL.view(np.int64).item())).alias("w"), F.col("n").alias("c"))
    return Counts(h[order], n[order], docs, tokens, int(total["v"]) + (docs > 0), int(total["once"]), parts), others


_SENT = pa.schema([
    ("kind", pa.int8()), ("part", pa.int32()), ("flush", pa.int64()), ("train", pa.binary()), ("packed", pa.binary()),
    ("entries", pa.int32()), ("far", pa.int32()), ("doc_id", pa.binary()), ("tokens", pa.binary()), ("known", pa.binary()), ("base", pa.binary()),
])


def _batches(schema: pa.Schema, rows: Iterator[dict | pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows, some hundreds to a batch, among batches that stay as they are."""
    held, size = [], 0
    for r in rows:
        if isinstance(r, pa.RecordBatch):
            yield r
            continue
        held.append(r)
        size += sum(len(x) for x in r.values() if isinstance(x, bytes))
        if len(held) >= BATCH_ROWS or size >= 1 << 21:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int8(): "tinyint", pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary", pa.float64(): "double"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def _pack(*arrays: np.ndarray) -> bytes:
    """Compressed together, the first bytes of all numbers of an array before the second ones: most numbers are small."""
    planes = [np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes() for a in arrays if len(a)]
    return pa.compress(b"".join(planes), codec="zstd", asbytes=True) if planes else b""


def _unpack(raw: bytes, *arrays: tuple[str, int]) -> list[np.ndarray]:
    """The arrays by their types and lengths."""
    sizes = [np.dtype(kind).itemsize * n for kind, n in arrays]
    if not sum(sizes):
        return [np.zeros(0, kind) for kind, _ in arrays]
    data, at, out = np.frombuffer(pa.decompress(raw, decompressed_size=sum(sizes), codec="zstd", asbytes=True), np.uint8), 0, []
    for (kind, n), size in zip(arrays, sizes):
        planes = data[at : at + size].reshape(np.dtype(kind).itemsize, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).ravel() if n else np.zeros(0, kind))
        at += size
    return out


def _key(h: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Small numbers for the dictionary's words, marked hashes for the others."""
    return np.where(place >= 0, place.astype(np.uint64) + np.uint64(8), h | TAIL)


def _send(shipped: Shipped):
    """Documents' tokens as bigrams by context, and what needs no exchange."""
    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict | pa.RecordBatch]:
        c = shipped.get()
        task = TaskContext.get().partitionId()
        number, held, size = 0, [], 0

        def send():
            h = np.concatenate([x[0] for x in held])
            for k, x in enumerate(held):
                held[k] = (None, *x[1:])
            count = np.concatenate([x[1] for x in held])
            ids = np.concatenate([x[2] for x in held])
            train = np.concatenate([x[3] for x in held])
            docs = len(ids)
            place, by = c.table().find(h), c.by_key()
            doc = np.repeat(np.arange(docs, dtype=np.uint64), count)
            bounds = np.concatenate(([0], np.cumsum(count)))
            # Words outside the dictionary are added where they are joined with their counts.
            base = np.bincount(doc.view(np.int64), by.base[place], minlength=docs) + c.base(np.float64(c.documents))
            known = run_sums((place >= 0).astype(np.int64), bounds) + (c.documents > 0)
            flush = task << 32 | number
            yield dict(
                kind=0, part=flush % c.parts, flush=flush, train=train.tobytes(), doc_id=ids.astype("<i8").tobytes(),
                tokens=(count + 1).astype("<i8").tobytes(), known=known.astype("<i8").tobytes(), base=base.astype("<f8").tobytes(),
            )
            key = _key(h, place)
            # Contexts: the start, then every word; followers: every word, then the end.
            v, w = np.empty(len(h) + docs, np.uint64), np.empty(len(h) + docs, np.uint64)
            at = np.arange(len(h)) + doc.view(np.int64)
            first = bounds[:-1] + np.arange(docs)
            v[first], w[first + count] = START, END
            v[at + 1], w[at] = key, key
            d = np.empty(len(v), np.uint64)
            d[at], d[first + count] = doc, np.arange(docs)
            del h, place, key, doc, at
            far = ((v | w) & TAIL) != 0
            rest = np.flatnonzero(far)
            bits, low = np.uint64(c.bits()), np.uint64(docs.bit_length())
            one = ~far
            both = np.sort((v[one] << bits | w[one]) << low | d[one])
            v, w, d = v[rest], w[rest], d[rest]
            del far, one
            # Near bigrams, of two dictionary words.
            fresh = np.flatnonzero(np.diff(both, prepend=~both[:1]) != 0)
            n, both = np.diff(fresh, append=len(both)), both[fresh]
            pair, doc = both >> low, both & ((np.uint64(1) << low) - np.uint64(1))
            ahead = pair >> bits
            part = _parts(c, by.home[ahead], by.pieces[ahead], by.mixed[pair & ((np.uint64(1) << bits) - np.uint64(1))])
            order = np.argsort(part, kind="stable")
            pair, doc, n = pair[order], doc[order].astype("<u2"), n[order]
            edges = np.searchsorted(part[order], np.arange(c.parts + 1))
            # Far ones, in the order of a hash: equal bigrams of a document stand together.
            order = np.argsort(mix64(mix64(v) + w) + d * np.uint64(0x9E3779B97F4A7C15))
            v, w, d = v[order], w[order], d[order]
            fresh = np.flatnonzero((np.diff(v, prepend=~v[:1]) != 0) | (np.diff(w, prepend=~w[:1]) != 0) | (np.diff(d, prepend=~d[:1]) != 0))
            far_n, v, w, d = np.diff(fresh, append=len(v)), v[fresh], w[fresh], d[fresh]
            small = np.where(v & TAIL, np.uint64(0), v)  # no word has the key 0
            part = _parts(c, mix64(v * np.uint64(3)), by.pieces[small], mix64(w))
            order = np.lexsort((v, part))
            v, w, d, far_n = v[order], w[order], d[order].astype("<u2"), far_n[order]
            far_edges = np.searchsorted(part[order], np.arange(c.parts + 1))
            # Whether an entry's document trains is the lowest bit of its number.
            n, far_n = ((x << 1 | train[y]).astype("<u4") for x, y in ((n, doc), (far_n, d)))
            for k in np.flatnonzero((np.diff(edges) + np.diff(far_edges)) > 0):
                s, f = slice(edges[k], edges[k + 1]), slice(far_edges[k], far_edges[k + 1])
                yield dict(
                    kind=1, part=int(k), flush=flush, entries=int(s.stop - s.start + f.stop - f.start), far=int(f.stop - f.start),
                    packed=_pack(pair[s], v[f], w[f], doc[s], d[f], n[s], far_n[f]),
                )

        for batch in batches:
            data, offsets = string_bytes(batch.column("text"))
            ids, train = batch.column("doc_id").fill_null(NO_ID).to_numpy(), ~np.asarray(batch.column("held_out").to_pylist(), bool)
            for a, b in slices(offsets, 1 << 20):
                h, _, bounds = words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                for x in range(a, b, 60_000):
                    y = min(x + 60_000, b)
                    own = bounds[x - a : y - a + 1]
                    if size >= c.hold() or sum(len(z[2]) for z in held) + y - x > 65_535:
                        yield from send()
                        number, held, size = number + 1, [], 0
                    held.append((h[own[0] : own[-1]], np.diff(own), ids[x:y], train[x:y]))
                    size += int(own[-1] - own[0]) + y - x
        if held:
            yield from send()

    return lambda batches: _batches(_SENT, rows_of(batches))


NO_ID = -(1 << 63)

# kind 0 as sent; 1: found estimates by document; 2: one cell of the histogram; 3: one bigram (``cell``: see _item) that
# ends in a word outside the dictionary, ``entries`` times in a document.
_FOUND = pa.schema([f for f in _SENT if f.name not in ("far", "part")] + [
    ("cell", pa.int64()), ("weight", pa.float64()), ("word_key", pa.int64()),
])


def _fixed(p: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        x = np.minimum(-np.log2(p) * SCALE, ABSENT)
    return np.where(p > 0, np.rint(x), ABSENT).astype(np.int64)


def _value(x: np.ndarray) -> np.ndarray:
    return np.where(x == ABSENT, 0.0, np.exp2(-x.astype(np.float64) / SCALE))


# Histogram cells: context class, bigram and word estimate by eighths of a power of two.
_BINS = ABSENT * 8 // SCALE + 2


def _item(doc: np.ndarray, bigram: np.ndarray, deleted: np.ndarray, klass: np.ndarray, train: np.ndarray) -> np.ndarray:
    """A bigram's document in its flush, estimate, deleted estimate's bin, context class, and whether it trains."""
    return doc.astype(np.int64) | bigram.astype(np.int64) << 16 | deleted.astype(np.int64) << 32 | klass.astype(np.int64) << 48 | train.astype(np.int64) << 56


def _rows(schema: pa.Schema, n: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


def _pack_hits(klass: np.ndarray, bigram: np.ndarray, word: np.ndarray) -> np.ndarray:
    return klass.astype(np.uint64) << np.uint64(32) | bigram.astype(np.uint64) << np.uint64(16) | word.astype(np.uint64)


def _cells(klass: np.ndarray, d2: np.ndarray, d1: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells of the histogram and their sums."""
    cells, where = np.unique((klass * _BINS + d2) * _BINS + d1, return_inverse=True)
    return cells, np.bincount(where, weight.astype(float), minlength=len(cells))


def _find_near(c: Counts, pair: np.ndarray, n: np.ndarray):
    """Estimates of bigrams of two dictionary words, and their histogram."""
    by, bits = c.by_key(), np.uint64(c.bits())
    order = np.argsort(pair)
    pair = pair[order]
    first = np.flatnonzero(np.diff(pair, prepend=~pair[:1]) != 0)
    size, count, pair = np.diff(first, append=len(pair)), np.add.reduceat(n[order], first, dtype=np.int64), pair[first]
    v, w = pair >> bits, pair & ((np.uint64(1) << bits) - np.uint64(1))
    total = by.seen[v]
    hits = np.empty(len(n), np.uint64)
    hits[order] = np.repeat(_pack_hits(by.klass[v], _fixed(count / np.maximum(total, 1)), by.word[w]), size)
    some = np.flatnonzero(count > 0)
    # Deleted: each of the pair's training tokens seen from the others.
    d2 = _fixed((count[some] - 1) / np.maximum(total[some] - 1, 1)) * 8 // SCALE
    return hits, _cells(by.klass[v[some]], d2, by.deleted[w[some]], count[some])


def _find_far(c: Counts, v: np.ndarray, w: np.ndarray, n: np.ndarray):
    """The same where a word is not in the dictionary; bins of the deleted estimates, too."""
    by = c.by_key()
    order = np.lexsort((w, v))
    v, w, n = v[order], w[order], n[order].astype(np.int64)
    fresh = np.diff(v, prepend=~v[:1]) != 0
    v_first = np.flatnonzero(fresh)
    pair_first = np.flatnonzero(fresh | (np.diff(w, prepend=~w[:1]) != 0))
    v_size, pair_size = np.diff(v_first, append=len(v)), np.diff(pair_first, append=len(v))
    # The dictionary knows a frequent context's count, of which this partition may hold a piece.
    context = np.repeat(np.add.reduceat(n, v_first), v_size)[pair_first]
    pair, v, w = np.add.reduceat(n, pair_first), v[pair_first], w[pair_first]
    total = np.where(v & TAIL, context, by.seen[np.where(v & TAIL, np.uint64(0), v)])
    klass, tail = _class(total), (w & TAIL) != 0
    small = np.where(tail, np.uint64(0), w)
    d2 = _fixed(np.maximum(pair - 1, 0) / np.maximum(total - 1, 1)) * 8 // SCALE
    some = np.flatnonzero((pair > 0) & ~tail)
    cells = _cells(klass[some], d2[some], by.deleted[small[some]], pair[some])
    hits, bins = np.empty(len(n), np.uint64), np.empty(len(n), "<u2")
    hits[order] = np.repeat(_pack_hits(klass, _fixed(pair / np.maximum(total, 1)), by.word[small]), pair_size)
    bins[order] = np.repeat(d2, pair_size)
    return hits, bins, cells


def _find(shipped: Shipped):
    """Counts every context of an exchange partition and looks its bigrams up."""
    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict | pa.RecordBatch]:
        c = shipped.get()
        rows, parts = [], []
        for batch in batches:
            for r in batch.to_pylist():
                if r["kind"] == 0:
                    yield {k: x for k, x in r.items() if k in _FOUND.names}
                    continue
                f = r["far"]
                k = r["entries"] - f
                rows.append((r["flush"], k, f))
                parts.append(_unpack(r["packed"], ("<u8", k), ("<u8", f), ("<u8", f), ("<u2", k), ("<u2", f), ("<u4", k), ("<u4", f)))
        if not rows:
            return
        near, v, w, doc, far_doc, n, far_n = (np.concatenate([x[k] for x in parts]) for k in range(7))
        del parts
        # Entries that train count; the lowest bit of a number tells.
        trained = lambda n: np.where(n & 1, n >> 1, 0).astype(np.uint32)
        cells, hits, tail = [], np.zeros(0, np.uint64), (w & TAIL) != 0
        if len(near):
            near, own = _find_near(c, near, trained(n))
            cells.append(own)
        if len(v):
            hits, bins, own = _find_far(c, v, w, trained(far_n))
            cells.append(own)
            single = np.flatnonzero(tail)
            flush = np.repeat([r[0] for r in rows], [r[2] for r in rows])[single]
            own, many = hits[single], far_n[single]
            yield _rows(
                _FOUND, len(single), kind=np.full(len(single), 3, np.int8), flush=flush, entries=(many >> 1).astype(np.int32),
                cell=_item(far_doc[single], own >> np.uint64(16) & np.uint64(0xFFFF), bins[single], own >> np.uint64(32), many & 1), word_key=w[single].view(np.int64),
            )
            del flush, own, many, bins, single
        for own, weight in cells:
            yield _rows(_FOUND, len(own), kind=np.full(len(own), 2, np.int8), cell=own, weight=weight)
        del cells, v, w
        # What was found by document, some rows at once.
        sizes = np.array([r[1:] for r in rows])
        ends = np.concatenate((np.zeros((1, 2), np.int64), np.cumsum(sizes, axis=0)))
        for a, b in slices(ends.sum(axis=1), CHUNK):
            s, f = (slice(ends[a, k], ends[b, k]) for k in range(2))
            stay = np.flatnonzero(~tail[f])
            row = np.concatenate([np.repeat(np.arange(b - a), sizes[a:b, k]) for k in range(2)])
            row = np.delete(row, len(row) - len(tail[f]) + np.flatnonzero(tail[f]))
            own_doc, own_n, own = (np.concatenate((x[s], y[f][stay])) for x, y in ((doc, far_doc), (n, far_n), (near, hits)))
            order = np.argsort(row << 16 | own_doc)
            own_doc, own_n, own = own_doc[order], own_n[order] >> np.uint32(1), own[order].view("<u2").reshape(-1, 4)
            klass, bigram, word = own[:, 2].astype("u1"), own[:, 1].copy(), own[:, 0].copy()
            edges = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=b - a))))
            for k in np.flatnonzero(np.diff(edges)):
                x = slice(edges[k], edges[k + 1])
                yield dict(kind=1, flush=rows[a + k][0], entries=int(x.stop - x.start), packed=_pack(own_doc[x], own_n[x], klass[x], bigram[x], word[x]))

    return lambda batches: _batches(_FOUND, rows_of(batches))


def _bits(at: int, width: int) -> Column:
    """A part of :func:`_item`."""
    return F.shiftright("cell", at).bitwiseAND(F.lit((1 << width) - 1))


def _fixed_column(count: Column, tokens: int) -> Column:
    """:func:`_fixed` of a count's share of all tokens."""
    x = F.rint(F.least(-F.log2(count / float(max(tokens, 1))) * float(SCALE), F.lit(float(ABSENT))))
    return F.when(count > 0, x).otherwise(float(ABSENT))


def joined_cells(joined: DataFrame, tokens: int) -> DataFrame:
    """Histogram cells of training bigrams that were joined with their word's count."""
    by = joined.where(_bits(56, 1) == 1).groupBy(_bits(48, 8).alias("klass"), _bits(32, 16).alias("d2"), "c").agg(F.sum("entries").alias("weight"))
    d1 = F.floor(_fixed_column(F.col("c") - 1, tokens) * 8 / SCALE)
    return by.select(((F.col("klass") * _BINS + F.col("d2")) * _BINS + d1).cast("long").alias("cell"), F.col("weight").cast("double").alias("weight"))


def joined_scores(joined: DataFrame, counts: Counts, mix: np.ndarray) -> DataFrame:
    """Their sums by document, as rows of kind 3: log-probabilities and base scores of the document ``entries`` of a
    flush, and how many were trained on."""
    share = [F.get(F.array(*[F.lit(float(x)) for x in mix[:, k]]), _bits(48, 8).cast("int")) for k in range(3)]
    value = lambda x: F.when(x == ABSENT, 0.0).otherwise(F.pow(F.lit(2.0), -x / float(SCALE)))
    p = share[0] * value(_bits(16, 16)) + share[1] * value(_fixed_column(F.col("c"), counts.tokens)) + share[2] * counts.uniform()
    base = F.log10((F.col("c") + 0.5) / (counts.tokens + 0.5 * (counts.kinds + 1)))
    sums = joined.groupBy("flush", _bits(0, 16).cast("int").alias("entries")).agg(
        F.sum(F.log10(p) * F.col("entries")).alias("weight"), F.sum(base * F.col("entries")).alias("far_base"),
        F.sum(F.when(F.col("c") > 0, F.col("entries")).otherwise(0)).cast("long").alias("far_known"),
    )
    have = {"kind": F.lit(3).cast("tinyint")} | {k: F.col(k) for k in sums.columns}
    return sums.select(*[have.get(f.name, F.lit(None)).alias(f.name) for f in _SUMS])


def learn_weights(cells: np.ndarray, weight: np.ndarray, uniform: float, steps: int = EM_STEPS) -> np.ndarray:
    """(context class, [bigram, word, uniform]) weights by expectation-maximisation."""
    klass, rest = cells // (_BINS * _BINS), cells % (_BINS * _BINS)
    x2, x1 = rest // _BINS, rest % _BINS
    top = ABSENT * 8 // SCALE
    p = np.stack([np.where(x == top, 0.0, np.exp2(-(x + 0.5) / 8)) for x in (x2, x1)] + [np.full(len(cells), uniform)], 1)
    mix = np.tile([0.4, 0.5, 0.1], (CLASSES, 1))
    for _ in range(steps):
        share = mix[klass] * p
        share /= np.maximum(share.sum(1, keepdims=True), 1e-300)
        new = np.stack([np.bincount(klass, share[:, k] * weight, minlength=CLASSES) for k in range(3)], 1)
        # A little of the uniform estimate always stays, so that every text has a probability.
        mix = (new + [0.5, 1.0, 0.5]) / (new.sum(1, keepdims=True) + 2.0)
    mix[0] = [0.0, mix[0][0] + mix[0][1], mix[0][2]]  # contexts never seen
    return mix


# kind 1: ``entries`` documents' sums, and the steps from one to the next; kind 3: see joined_scores.
_SUMS = pa.schema([f for f in _FOUND if f.name in ("kind", "flush", "train", "packed", "doc_id", "tokens", "known", "base", "entries", "weight")] + [
    ("far_base", pa.float64()), ("far_known", pa.int64()),
])


def _sum(shipped: Shipped):
    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        mix, uniform = shipped.get()
        value = _value(np.arange(ABSENT + 1))
        shares = [mix[:, 0].copy(), mix[:, 1].copy(), mix[:, 2] * uniform]

        def summed(rows: list[dict]) -> Iterator[dict]:
            sizes = [r["entries"] for r in rows]
            parts = [_unpack(r["packed"], ("<u2", k), ("<u4", k), ("u1", k), ("<u2", k), ("<u2", k)) for r, k in zip(rows, sizes)]
            doc, n, klass, bigram, word = (np.concatenate([x[k] for x in parts]) for k in range(5))
            p = shares[0][klass] * value[bigram]
            p += shares[1][klass] * value[word]
            p += shares[2][klass]
            # Only documents that have such bigrams are sent; entries of a row stand by document.
            fresh = np.diff(doc, prepend=~doc[:1]) != 0
            fresh[np.cumsum(sizes)[:-1]] = True
            first = np.flatnonzero(fresh)
            score = (np.add.reduceat(np.log(p) * n, first) / np.log(10.0)).astype("<f4")
            edges = np.searchsorted(first, np.concatenate(([0], np.cumsum(sizes))))
            doc = doc[first]
            for r, a, b in zip(rows, edges, edges[1:]):
                yield dict(kind=1, flush=r["flush"], entries=int(b - a), packed=_pack(np.diff(doc[a:b], prepend=np.uint16(0)), score[a:b]))

        held, size = [], 0
        for batch in batches:
            for r in batch.to_pylist():
                if r["kind"] == 0:
                    yield {k: x for k, x in r.items() if k in _SUMS.names}
                    continue
                held.append(r)
                size += r["entries"]
                if size >= CHUNK:
                    yield from summed(held)
                    held, size = [], 0
        if held:
            yield from summed(held)

    return lambda batches: _batches(_SUMS, rows_of(batches))


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    docs, sums, joined = {}, {}, []
    for batch in batches:
        single = batch.column("kind").to_numpy() == 3
        if single.any():
            joined.append([batch.column(k).filter(pa.array(single)).to_numpy() for k in ("flush", "entries", "weight", "far_base", "far_known")])
            batch = batch.filter(pa.array(~single))
        for r in batch.to_pylist():
            if r["kind"] == 0:
                docs[r["flush"]] = r
                continue
            k = r["entries"]
            at, score = _unpack(r["packed"], ("<u2", k), ("<f4", k))
            at = np.cumsum(at, dtype=np.int64)
            own = sums.get(r["flush"], np.zeros(0))
            if len(own) <= at[-1]:
                own = sums[r["flush"]] = np.concatenate((own, np.zeros(int(at[-1]) + 1 - len(own))))
            own[at] += score
    if joined:
        joined = [np.concatenate([x[k] for x in joined]) for k in range(5)]
        order = np.argsort(joined[0], kind="stable")
        of, doc, *joined = [x[order] for x in joined]
    for flush, r in docs.items():
        ids = np.frombuffer(r["doc_id"], "<i8")
        own = np.zeros((3, len(ids)))
        if (have := sums.get(flush)) is not None:
            own[0, : len(have)] = have
        if joined:
            s = slice(*np.searchsorted(of, [flush, flush + 1]))
            for k, x in enumerate(joined):
                own[k] += np.bincount(doc[s], x[s], minlength=len(ids))
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, mask=ids == NO_ID), pa.array(~np.frombuffer(r["train"], bool)), pa.array(np.frombuffer(r["tokens"], "<i8")),
             pa.array(np.frombuffer(r["known"], "<i8") + np.rint(own[2]).astype(np.int64)), pa.array(np.frombuffer(r["base"], "<f8") + own[1]), pa.array(own[0])],
            ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"],
        )


def score(documents: DataFrame, held_out) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)``
    of ``documents(doc_id, text)``; rows where ``held_out`` is not true train.

    NULL texts are empty: only their end is scored.  Without training rows
    the model is uniform.  Repeated rows count, and are scored, each.
    """
    spark = documents.sparkSession
    narrow_batches(spark)
    rows = documents.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    counts, others = fit_counts(rows.where("NOT held_out"))
    shipped = Shipped(spark, counts)
    sent = rows.mapInArrow(_send(shipped), _ddl(_SENT))
    found = stored(sent.repartition(counts.parts, "part").mapInArrow(_find(shipped), _ddl(_FOUND)), "bigrams")
    # Words outside the dictionary meet their counts; those never trained on have none.
    single = found.where("kind = 3").select("flush", "entries", "cell", F.col("word_key").alias("w"))
    joined = stored(single.join(others, "w", "left").select("flush", "entries", "cell", F.coalesce("c", F.lit(0)).alias("c")), "joined")
    cells = found.where("kind = 2").select("cell", "weight").union(joined_cells(joined, counts.tokens))
    cells = cells.groupBy("cell").agg(F.sum("weight").alias("weight")).toPandas()
    mix = learn_weights(cells["cell"].to_numpy(np.int64), cells["weight"].to_numpy(float), counts.uniform())
    sums = found.where("kind < 2").mapInArrow(_sum(Shipped(spark, (mix, counts.uniform()))), _ddl(_SUMS))
    sums = sums.unionByName(joined_scores(joined, counts, mix))
    out = sums.repartition(max(2 * spark.sparkContext.defaultParallelism, counts.parts // 4), "flush").mapInArrow(
        _gather, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    )
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(counts.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def lm_scoring(documents: DataFrame) -> DataFrame:
    """``score`` with the rows held out whose crc32(doc_id) modulo 5 is 1."""
    return score(documents, crc_mod("doc_id", 5) == 1)
