"""Words and shingles of whole texts as 64-bit hashes, straight from UTF-8.

A word is a maximal run of bytes other than space and 0x09 to 0x0D, A-Z
lowered.  White space of that class is ASCII, so no decoding is needed.
"""

from __future__ import annotations

import hashlib

import numpy as np

from .common import mix64, powers, ragged

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
MASK = (1 << 64) - 1


def byte_codes(lower: bool = True) -> np.ndarray:
    """A fixed pseudo-random 64-bit code per byte; A-Z share those of a-z."""
    codes = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    if lower:
        codes[65:91] = codes[97:123]
    return codes


def is_space(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def run_bounds(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of True that stay inside one document."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edge = offsets[(offsets > 0) & (offsets < len(inside))]
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """Hash of the bytes of every span, from one running sum over the data."""
    n = len(data)
    if not len(starts):
        return np.zeros(0, np.uint64)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(byte_codes(lower)[data] * powers(BASE, n), out=total[1:])
    h = (total[ends] - total[starts]) * powers(INVERSE, n)[starts]
    return mix64(h ^ ((ends - starts).astype(np.uint64) << np.uint64(48)))


def span_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit keys of the bytes of every span, eight bytes to a mixing step.

    Unlike the sums of ``span_hashes``, no pattern of two letters makes two
    spans meet; spans over 64 bytes go through BLAKE2b.
    """
    size = ends - starts
    pad = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.ndarray(len(data) + 1, "<u8", pad, strides=(1,))
    out = mix64(size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    rows = np.flatnonzero(size <= 64)
    at, left = starts[rows], size[rows]
    while len(rows):
        part = eight[at]
        short = left < 8
        part[short] &= (np.uint64(1) << (left[short] * 8).astype(np.uint64)) - np.uint64(1)
        out[rows] = mix64((out[rows] ^ part) + np.uint64(0xD1342543DE82EF95))
        more = left > 8
        rows, at, left = rows[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(size > 64).tolist():
        own = hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest()
        out[i] = np.uint64(int.from_bytes(own, "little"))
    return out


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, bounds): the words of document d are bounds[d]:bounds[d + 1]."""
    starts, ends = run_bounds(~is_space(data), offsets)
    return span_hashes(data, starts, ends), starts, np.searchsorted(starts, offsets)


def shingles(hashes: np.ndarray, bounds: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``size``-word shingles in text order, and bounds per document.

    With fewer words the whole sequence is one shingle; without words, none.
    """
    mult = [int(x) | 1 for x in mix64(np.arange(11, 11 + size, dtype=np.uint64))]
    count = np.diff(bounds)
    full = np.maximum(count - size + 1, 0)
    n = max(len(hashes) - size + 1, 0)
    rolled = np.zeros(n, np.uint64)
    for j, m in enumerate(mult):
        rolled += hashes[j : j + n] * np.uint64(m)
    rolled = mix64(rolled)
    out_count = np.where(full > 0, full, (count > 0).astype(np.int64))
    out_bounds = np.concatenate(([0], np.cumsum(out_count)))
    out = np.empty(int(out_bounds[-1]), np.uint64)
    long = np.flatnonzero(full > 0)
    if len(long):
        out[ragged(out_bounds[long], full[long])] = rolled[ragged(bounds[long], full[long])]
    for d in np.flatnonzero((count > 0) & (full == 0)):
        h = hashes[bounds[d] : bounds[d + 1]]
        with np.errstate(over="ignore"):
            own = sum(int(x) * m for x, m in zip(h.tolist(), mult)) + len(h) * 0x5851F42D4C957F2D
        out[out_bounds[d]] = mix64(np.array([own & MASK], np.uint64))[0]
    return out, out_bounds
