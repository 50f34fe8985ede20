"""SentencePiece encoding and decoding by batched Viterbi in numpy.

Texts are cut into words that no piece reaches across.  Distinct words of
equal length advance together through the lattice of their pieces: at every
place the hashes of all substrings that end there probe the sorted piece
keys, and the best of them is kept with a backpointer.

For a unigram model the best is the largest sum of scores.  A merge (BPE)
model has no such sum: there, a piece may follow another only if merging the
two alone would leave the boundary between them, and exactly one piece that
ends at a place may follow the one before it.  (A boundary that merges of a
whole word cross is crossed in its two neighbouring pieces alone, since merges
inside pieces do not see what is outside.)  So the same walk, with the
maximum over allowed pieces, gives exactly the merges' result.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from .common import HashTable, IdCache, Shipped, mix64, narrow_batches, powers, slices, string_bytes, ragged, worker_cache
from .text import BASE, INVERSE

# Kinds of pieces and models in the model file (fixed values of the format).
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
SPACE = "▁"
UNKNOWN_PENALTY = 10.0
CACHE_WORDS = 1_000_000
NOTHING = -1  # what stands before a word
STRANGE = 1 << 24  # added to a character that is no piece


def _fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a protocol-buffer message's fields."""
    at = 0

    def number():
        nonlocal at
        out = shift = 0
        while True:
            byte = raw[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(raw):
        tag = number()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, number()
        elif kind == 1:
            at += 8
            yield tag >> 3, raw[at - 8 : at]
        elif kind == 2:
            size = number()
            at += size
            yield tag >> 3, raw[at - size : at]
        elif kind == 5:
            at += 4
            yield tag >> 3, struct.unpack("<f", raw[at - 4 : at])[0]
        else:
            raise ValueError("not a model file")


class Model:
    """Pieces, scores and settings of a model file."""

    def __init__(self, raw: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        self.algorithm, self.prefix = UNIGRAM, True
        squeeze = True
        for field, value in _fields(raw):
            if field == 1:
                piece = {1: b"", 2: 0.0, 3: NORMAL} | dict(_fields(value))
                self.pieces.append(piece[1].decode())
                self.scores.append(piece[2])
                self.kinds.append(piece[3])
            elif field == 2:
                self.algorithm = dict(_fields(value)).get(3, UNIGRAM)
            elif field == 3:
                spec = dict(_fields(value))
                self.prefix, squeeze = bool(spec.get(3, 1)), bool(spec.get(4, 1))
                if spec.get(2) or not spec.get(5, 1):
                    raise ValueError("only models that keep characters as they are can be used")
        if squeeze or self.algorithm not in (UNIGRAM, BPE) or USER in self.kinds:
            raise ValueError("unsupported model settings")


class Encoder:
    """Encodes and decodes batches of texts; keeps words and pairs it has met."""

    def __init__(self, model: Model):
        self.model = model
        self.known = IdCache(CACHE_WORDS)
        usable = [i for i, k in enumerate(model.kinds) if k == NORMAL]
        self.text = {model.pieces[i]: i for i in usable}
        self.longest = max(map(len, self.text), default=1)
        self.byte = {int(model.pieces[i][3:5], 16): i for i, k in enumerate(model.kinds) if k == BYTE}
        self.unknown = model.kinds.index(UNKNOWN) if UNKNOWN in model.kinds else 0
        codes = [np.array([ord(c) for c in p], np.uint64) for p in self.text]
        hashes = np.array([_hash(c) for c in codes], np.uint64)
        order = np.argsort(hashes)
        self.table = HashTable(hashes[order])
        self.ids = np.array(usable, np.int64)[order] if usable else np.zeros(0, np.int64)
        self.scores = np.array(model.scores)
        self.lowest = min((model.scores[i] for i in usable), default=0.0)
        # Characters of no longer piece are words of their own.
        self.joined = np.zeros(0x110000, bool)
        for p in self.text:
            if len(p) > 1:
                self.joined[[ord(c) for c in p]] = True
        self.whole = any(b == SPACE and a != SPACE for p in self.text for a, b in zip(p, p[1:]))
        self.pair_keys, self.pair_ok = np.zeros(0, np.uint64), np.zeros(0, bool)
        raw = [bytes([next(b for b, j in self.byte.items() if j == i)]) if k == BYTE else
               b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else p.replace(SPACE, " ").encode()
               for i, (p, k) in enumerate(zip(model.pieces, model.kinds))]
        self.raw_size = np.array([len(x) for x in raw], np.int64)
        self.raw_at = np.cumsum(self.raw_size) - self.raw_size
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.spaced = np.array([p.startswith(SPACE) for p in model.pieces])

    # Encoding

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, bounds per text)."""
        full = [(SPACE + t if self.model.prefix else t) if t else "" for t in texts]
        codes = np.frombuffer("".join(full).encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = np.where(codes == 32, ord(SPACE), codes).astype(np.uint64)
        bounds = np.concatenate(([0], np.cumsum(np.fromiter(map(len, full), np.int64, len(full)))))
        starts = self._cuts(codes, bounds)
        ends = np.append(starts[1:], len(codes))
        total = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(mix64(codes + np.uint64(7)) * powers(BASE, len(codes)), out=total[1:])
        inverse = powers(INVERSE, len(codes) + 1)
        length = ends - starts
        keys = mix64((total[ends] - total[starts]) * inverse[starts] ^ (length.astype(np.uint64) << np.uint64(40)))
        keys, first, where = np.unique(keys, return_index=True, return_inverse=True)
        new = self.known.missing(keys)
        if len(new):
            at, size = starts[first[new]], length[first[new]]
            found: list = [None] * len(new)
            for n in np.unique(size):
                rows = np.flatnonzero(size == n)
                for part in np.array_split(rows, -(-len(rows) * int(n) // (1 << 18))):
                    for r, ids in zip(part, self._walk(codes[at[part][:, None] + np.arange(n)])):
                        found[r] = ids
            self.known.add(keys[new], np.fromiter(map(len, found), np.int64, len(found)), np.concatenate(found).astype(np.uint32))
        ids, sizes = self.known.gather(keys, where)
        return ids, sizes[np.searchsorted(starts, bounds)]

    def _cuts(self, codes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        n = len(codes)
        cut = np.zeros(n, bool)
        if n and not self.whole:
            blank = codes == ord(SPACE)
            cut[1:] = blank[1:] & ~blank[:-1]
            alone = ~self.joined[codes.astype(np.int64)]
            cut |= alone
            cut[1:] |= alone[:-1]
        cut[bounds[:-1][bounds[:-1] < bounds[1:]]] = True
        return np.flatnonzero(cut)

    def _walk(self, words: np.ndarray) -> list[np.ndarray]:
        """Ids of the rows of ``words``, all of one length."""
        count, n = words.shape
        total = np.zeros((count, n + 1), np.uint64)
        np.cumsum(mix64(words + np.uint64(7)) * powers(BASE, n), axis=1, out=total[:, 1:])
        inverse = powers(INVERSE, n + 1)
        last = np.full((count, n + 1), NOTHING, np.int64)
        back = np.zeros((count, n + 1), np.int64)
        best = np.zeros((count, n + 1))
        rows = np.arange(count)
        for i in range(1, n + 1):
            sizes = np.arange(1, min(i, self.longest) + 1)
            h = mix64((total[:, i, None] - total[:, i - sizes]) * inverse[i - sizes] ^ (sizes.astype(np.uint64) << np.uint64(40)))
            place = self.table.find(h.ravel()).reshape(h.shape)
            piece = np.where(place >= 0, self.ids[place], -1) if len(self.ids) else np.full(h.shape, -1)
            own = words[:, i - 1].astype(np.int64) + STRANGE
            piece[:, 0] = np.where(piece[:, 0] >= 0, piece[:, 0], own)
            before = last[:, i - sizes]
            if self.model.algorithm == UNIGRAM:
                value = np.where(piece >= STRANGE, self.lowest - UNKNOWN_PENALTY, self.scores[np.where(piece < STRANGE, piece, 0)])
                value = np.where(piece >= 0, best[:, i - sizes] + value, -np.inf)
            else:
                value = np.where((piece >= 0) & self._allowed(before, piece), 0.0, -np.inf)
            pick = value.argmax(1)
            best[:, i], last[:, i], back[:, i] = value[rows, pick], piece[rows, pick], sizes[pick]
        out = []
        for r in range(count):
            at, ids = n, []
            while at:
                ids.append(last[r, at])
                at -= back[r, at]
            out.append(self._final(ids[::-1]))
        return out

    def _final(self, ids: list[int]) -> np.ndarray:
        """Characters that are no piece become bytes, or one unknown piece a run."""
        out: list[int] = []
        for i in ids:
            if i < STRANGE:
                out.append(i)
            elif self.byte:
                out += [self.byte[b] for b in chr(i - STRANGE).encode("utf-8", "surrogatepass")]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return np.array(out, np.int64)

    def _allowed(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Whether merges leave the boundary between two pieces, for arrays of pairs."""
        key = ((before + 1).astype(np.uint64) << np.uint64(32)) | np.where(piece >= 0, piece + 1, 0).astype(np.uint64)
        asked, where = np.unique(key, return_inverse=True)
        place = np.searchsorted(self.pair_keys, asked)
        known = np.zeros(len(asked), bool)
        inside = place < len(self.pair_keys)
        known[inside] = self.pair_keys[place[inside]] == asked[inside]
        new = asked[~known]
        if len(new):
            ok = np.array([self._stays(int(k >> np.uint64(32)) - 1, int(k & np.uint64(0xFFFFFFFF)) - 1) for k in new])
            at = np.searchsorted(self.pair_keys, new)
            self.pair_keys, self.pair_ok = np.insert(self.pair_keys, at, new), np.insert(self.pair_ok, at, ok)
        return self.pair_ok[np.searchsorted(self.pair_keys, asked)][where].reshape(piece.shape)

    def _name(self, piece: int) -> str:
        return chr(piece - STRANGE) if piece >= STRANGE else self.model.pieces[piece]

    def _stays(self, before: int, piece: int) -> bool:
        if piece < 0:
            return False
        names = [self._name(piece)] if before == NOTHING else [self._name(before), self._name(piece)]
        return merge(list("".join(names)), self.text, self.model.scores) == names

    # Decoding

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """Texts of runs of ids; the space in front of the first piece goes, as it was added."""
        ids = ids.astype(np.int64)
        size, at = self.raw_size[ids].copy(), self.raw_at[ids].copy()
        if self.model.prefix:
            first = bounds[:-1][bounds[:-1] < bounds[1:]]
            cut = self.spaced[ids[first]].astype(np.int64)
            size[first] -= cut
            at[first] += cut
        data = self.raw[ragged(at, size)].tobytes()
        ends = np.concatenate(([0], np.cumsum(size)))[bounds]
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(ends, ends[1:])]


def merge(symbols: list[str], pieces: dict[str, int], scores: list[float]) -> list[str]:
    """Joins the neighbours whose piece has the highest score, leftmost first, until none is a piece."""
    while True:
        best = None
        for k in range(len(symbols) - 1):
            i = pieces.get(symbols[k] + symbols[k + 1])
            if i is not None and (best is None or scores[i] > best[0]):
                best = scores[i], k
        if best is None:
            return symbols
        k = best[1]
        symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]


def _hash(codes: np.ndarray) -> np.uint64:
    total = (mix64(codes + np.uint64(7)) * powers(BASE, len(codes))).sum(dtype=np.uint64)
    return mix64(np.array([total ^ (np.uint64(len(codes)) << np.uint64(40))], np.uint64))[0]


def load(path: str) -> Model:
    with open(path, "rb") as f:
        return Model(f.read())




def encode(docs: DataFrame, model: Model, keep_ids: bool = True) -> DataFrame:
    """``docs`` plus ``n_ids``, ``ids``, ``ids_crc32`` (of the ids as unsigned
    32-bit little-endian numbers), ``round_trip`` (decoding the ids gives the
    text again) and, of every text, ``decoded_crc32``.

    NULL and empty texts have no ids.  A text that holds the piece alphabet's
    own space sign decodes to a plain space there.  Columns of the input with
    these names are replaced; without ``keep_ids`` the lists are left out.
    """
    kinds = {"n_ids": T.LongType(), "ids": T.ArrayType(T.IntegerType()), "ids_crc32": T.LongType(), "round_trip": T.BooleanType(), "decoded_crc32": T.LongType()}
    if not keep_ids:
        del kinds["ids"]
    base = docs.select([c for c in docs.columns if c not in kinds])
    schema = T.StructType(base.schema.fields + [T.StructField(c, k) for c, k in kinds.items()])
    narrow_batches(docs.sparkSession)
    shipped = Shipped(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = worker_cache()
        if cache.get("pieces", (None,))[0] != shipped.token:
            cache["pieces"] = shipped.token, Encoder(shipped.get())
        encoder = cache["pieces"][1]
        for batch in batches:
            column = batch.column("text")
            _, offsets = string_bytes(column)
            texts = [t or "" for t in column.to_pylist()]
            out: dict[str, list] = {c: [] for c in kinds}
            for a, b in slices(offsets, 1 << 21):
                ids, bounds = encoder.encode(texts[a:b])
                back = encoder.decode(ids, bounds)
                small = ids.astype("<u4")
                for d in range(b - a):
                    own = small[bounds[d] : bounds[d + 1]]
                    out["n_ids"].append(len(own))
                    out["ids_crc32"].append(zlib.crc32(own.tobytes()))
                    out["round_trip"].append(back[d] == texts[a + d])
                    out["decoded_crc32"].append(zlib.crc32(back[d].encode("utf-8", "surrogatepass")))
                    if keep_ids:
                        out["ids"].append(own.view(np.int32))
            types = {"n_ids": pa.int64(), "ids": pa.list_(pa.int32()), "ids_crc32": pa.int64(), "round_trip": pa.bool_(), "decoded_crc32": pa.int64()}
            yield pa.RecordBatch.from_arrays(
                batch.columns + [pa.array(out[c], types[c]) for c in kinds], batch.schema.names + list(kinds)
            )

    return base.mapInArrow(run, schema)
