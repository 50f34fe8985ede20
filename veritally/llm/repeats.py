"""Periodic runs of words, found in a grammar of the texts.

Re-Pair replaces pairs of neighbouring symbols by nonterminals, the most
frequent first: every round takes the pairs that occur at least half as often
as the most frequent one, and of two that overlap the more frequent, until no
pair occurs twice.  What is left of a document is joined by a balanced tree.
A run has at least four periods, so at the node of the derivation where it
crosses from the left part to the right one, one side holds two periods of it:
for every nonterminal, once, the periods of squares beside its boundary are
tested and extended.  Found stretches are translated to all places where the
nonterminal was derived, and of those with one period the maximal ones stay.

Equalities are tested by residues of two primes, which miss none; what they
find is compared word by word at the end, and a document with a false one is
searched again without them.

A slice of documents of about ``SLICE_BYTES`` shares one grammar, so copies
are searched once; a longer document is a slice of its own.  Odd cases: NULL,
empty and blank texts have no words and no runs; runs never reach across
documents; repeated and NULL doc_ids are rows like all others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import ragged, slices, string_bytes, worker_cache
from .text import is_space, run_bounds, span_keys

# A run has at least so many words and so many periods.
LEAST_WORDS = 6
LEAST_PERIODS = 4
SLICE_BYTES = 1 << 20
# Tests of (nonterminal, period) made at once.
TESTS = 1 << 21
PRIMES = (2_147_483_647, 2_147_483_629)
BASES = (1_103_515_245, 1_664_525_017)


class Grammar:
    """Rules of a slice: lengths of both parts, first place, and all places."""

    def __init__(self, words: np.ndarray, bounds: np.ndarray):
        n = len(words)
        self.terminals = int(words.max()) + 1 if n else 0
        self.symbol, self.at = words.astype(np.int64), np.arange(n, dtype=np.int64)
        self.last = np.zeros(n, bool)
        self.last[bounds[1:][bounds[1:] > bounds[:-1]] - 1] = True
        self.size = [np.ones(self.terminals, np.int64)]
        self.rules = 0
        self.known, self.name = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.left: list[np.ndarray] = []
        self.right: list[np.ndarray] = []
        self.first: list[np.ndarray] = []
        self.place_rule: list[np.ndarray] = []
        self.place: list[np.ndarray] = []
        while self._round():
            pass
        while self._join():
            pass
        self.left, self.right, self.first = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (self.left, self.right, self.first))
        self.place_rule, self.place = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (self.place_rule, self.place))

    def _sizes(self) -> np.ndarray:
        if len(self.size) > 1:
            self.size = [np.concatenate(self.size)]
        return self.size[0]

    def _replace(self, i: np.ndarray, rule: np.ndarray, fresh: np.ndarray) -> None:
        """Symbols i and i + 1 become ``rule``; ``fresh`` has an i for every new rule."""
        size = self._sizes()
        left, right = size[self.symbol[fresh]], size[self.symbol[fresh + 1]]
        self.left.append(left)
        self.right.append(right)
        self.first.append(self.at[fresh])
        self.size.append(left + right)
        self.rules += len(fresh)
        self.place_rule.append(rule)
        self.place.append(self.at[i])
        self.symbol[i] = self.terminals + rule
        self.last[i] = self.last[i + 1]
        keep = np.ones(len(self.symbol), bool)
        keep[i + 1] = False
        self.symbol, self.at, self.last = self.symbol[keep], self.at[keep], self.last[keep]

    def _round(self) -> bool:
        if len(self.symbol) < 2:
            return False
        key = (self.symbol[:-1] << 32) | self.symbol[1:]
        # Most pairs that occur once are ruled out by a small table of counts.
        bits = max(10, min(22, len(key).bit_length() + 1))
        slot = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)
        valid = np.flatnonzero(~self.last[:-1])
        count = np.bincount(slot[valid], minlength=1 << bits)
        some = valid[count[slot[valid]] >= 2]
        if not len(some):
            return False
        own = key[some]
        order = np.argsort(own, kind="stable")
        first = np.flatnonzero(np.diff(own[order], prepend=own[order[0]] - 1))
        times = np.diff(first, append=len(own))
        most = int(times.max())
        if most < 2:
            return False
        group = np.empty(len(own), np.int64)
        group[order] = np.repeat(np.arange(len(first)), times)
        # Places by the pair's rank: the more frequent first, then in order of keys.
        rank = np.empty(len(first), np.int64)
        rank[np.lexsort((-np.arange(len(first)), times))] = np.arange(1, len(first) + 1)
        wanted = times[group] >= max(2, most // 2)
        strength = np.zeros(len(key) + 2, np.int64)
        strength[some[wanted] + 1] = rank[group[wanted]]
        which = np.zeros(len(key), np.int64)
        which[some] = group
        taken = []
        while True:
            i = np.flatnonzero(strength)
            if not len(i):
                break
            here, before, after = strength[i], strength[i - 1], strength[i + 1]
            # A stretch of equal pairs (a a a ...) is taken at every other place.
            begins = before != here
            start = np.flatnonzero(begins)
            length = np.diff(start, append=len(i))
            best = (here[start] > before[start]) & (here[start] > after[start + length - 1])
            picked = i[np.repeat(best, length) & ((np.arange(len(i)) - np.repeat(start, length)) % 2 == 0)]
            taken.append(picked)
            strength[picked] = strength[picked - 1] = strength[picked + 1] = 0
        i = np.sort(np.concatenate(taken)) - 1
        keys, one, back = np.unique(which[i], return_index=True, return_inverse=True)
        pairs = key[i[one]]
        spot = np.searchsorted(self.known, pairs)
        old = np.zeros(len(pairs), bool)
        inside = spot < len(self.known)
        old[inside] = self.known[spot[inside]] == pairs[inside]
        name = np.empty(len(pairs), np.int64)
        name[old] = self.name[spot[old]]
        name[~old] = self.rules + np.arange(int((~old).sum()))
        self.known, self.name = np.insert(self.known, spot[~old], pairs[~old]), np.insert(self.name, spot[~old], name[~old])
        self._replace(i, name[back], i[one[~old]])
        return True

    def _join(self) -> bool:
        """Joins neighbours of every document, the first with the second and so on."""
        n = len(self.symbol)
        begin = np.flatnonzero(np.concatenate(([True], self.last[:-1]))) if n else np.zeros(0, np.int64)
        place = np.arange(n) - np.repeat(begin, np.diff(begin, append=n))
        i = np.flatnonzero((place % 2 == 0) & ~self.last)
        if len(i):
            self._replace(i, self.rules + np.arange(len(i)), i)
        return bool(len(i))


class Residues:
    """Equality and common extensions of stretches of a sequence of ids."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        self.sums, self.power = [], []
        for p, base in zip(PRIMES, BASES):
            power = _powers(p, base, n + 1)
            sums = np.zeros(n + 1, np.int64)
            np.cumsum((words + 1) * power[:n] % p, out=sums[1:])
            self.sums.append(sums % p)
            self.power.append(power)

    def equal(self, u: np.ndarray, v: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether words u.. and v.. (u < v) are the same for ``size`` words."""
        same = np.ones(len(u), bool)
        for p, sums, power in zip(PRIMES, self.sums, self.power):
            own, other = (sums[u + size] - sums[u]) % p, (sums[v + size] - sums[v]) % p
            same &= own * power[v - u] % p == other
        return same

    def extend(self, u: np.ndarray, v: np.ndarray, most: np.ndarray, back: bool = False) -> np.ndarray:
        """The largest size up to ``most`` for which words from u and v on (or before them) are the same."""
        low, high = np.zeros(len(u), np.int64), most.copy()
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                return low
            size = (low[open_] + high[open_] + 1) // 2
            shift = size if back else 0
            same = self.equal(u[open_] - shift, v[open_] - shift, size)
            low[open_[same]] = size[same]
            high[open_[~same]] = size[~same] - 1


def _powers(p: int, base: int, n: int) -> np.ndarray:
    cache = worker_cache()
    have = cache.get(("residues", p))
    if have is None or len(have) < n:
        have = np.ones(1, np.int64)
        step = base
        while len(have) < n:
            have = np.concatenate((have, have * step % p))
            step = step * step % p
        if len(have) <= 8 * SLICE_BYTES:
            cache[("residues", p)] = have
    return have


def _crossing(words: np.ndarray, grammar: Grammar, residues: Residues, least: int, power: int):
    """(rule, start, end, period) of stretches that cross a rule's boundary, at its first place."""
    size = grammar.left + grammar.right
    out = []
    for side, own in ((0, grammar.right), (1, grammar.left)):
        most = np.where(size >= least, np.minimum(own // 2, size // power), 0)
        rules = np.flatnonzero(most)
        ends = np.cumsum(most[rules])
        for low in range(0, int(ends[-1]) if len(ends) else 0, TESTS):
            a, b = np.searchsorted(ends, [low, low + TESTS - 1], "right")
            b = min(b, len(rules) - 1)
            begin = ends[a : b + 1] - most[rules[a : b + 1]]
            skip = np.maximum(low - begin, 0)
            many = np.minimum(ends[a : b + 1], low + TESTS) - begin - skip
            rule, period = np.repeat(rules[a : b + 1], many), ragged(skip + 1, many)
            middle = grammar.first[rule] + grammar.left[rule]
            # The first word of a square beside the boundary, then all of it.
            near = middle if side == 0 else middle - 1
            hit = np.flatnonzero(words[near] == words[near + period if side == 0 else near - period])
            rule, period, middle = rule[hit], period[hit], middle[hit]
            u = middle if side == 0 else middle - 2 * period
            hit = np.flatnonzero(residues.equal(u, u + period, period))
            rule, period, u = rule[hit], period[hit], u[hit]
            v, start = u + period, grammar.first[rule]
            end = start + size[rule]
            end = v + residues.extend(u, v, end - v)
            start = u - residues.extend(u, v, u - start, back=True)
            good = np.flatnonzero(end - start >= np.maximum(least, power * period))
            out.append(np.stack((rule[good], start[good], end[good], period[good])))
    found = np.concatenate(out, axis=1) if out else np.zeros((4, 0), np.int64)
    order = np.lexsort((found[3], found[2], found[1], found[0]))
    found = found[:, order]
    return found[:, np.any(np.diff(found[:3], axis=1, prepend=-1), axis=0)] if found.shape[1] else found


def _maximal(start: np.ndarray, end: np.ndarray, period: np.ndarray, n: int):
    """Of stretches with one period the ones inside no other; of equal ones the smallest period."""
    order = np.lexsort((-end, start, period))
    start, end, period = start[order], end[order], period[order]
    reach = end + period * (n + 1)
    keep = np.ones(len(start), bool)
    keep[1:] = reach[1:] > np.maximum.accumulate(reach)[:-1]
    start, end, period = start[keep], end[keep], period[keep]
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    keep = np.ones(len(start), bool)
    keep[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, period = start[keep], end[keep], period[keep]
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def plain_runs(words: np.ndarray, least: int = LEAST_WORDS, power: int = LEAST_PERIODS) -> list[tuple[int, int, int]]:
    """(start, end, period) of the runs of one document, period by period."""
    found: dict[tuple[int, int], int] = {}
    for q in range(1, len(words) // power + 1):
        same = np.concatenate(([False], words[q:] == words[:-q], [False]))
        edge = np.flatnonzero(same[1:] != same[:-1])
        for a, b in zip(edge[::2].tolist(), (edge[1::2] + q).tolist()):
            if b - a >= max(least, power * q):
                found.setdefault((a, b), q)
    return sorted((a, b, q) for (a, b), q in found.items())


def find_runs(words: np.ndarray, bounds: np.ndarray, least: int = LEAST_WORDS, power: int = LEAST_PERIODS):
    """(start, end, period) arrays of the runs of all documents, by start, then period.

    ``words`` are ids from 0; document d is ``bounds[d]:bounds[d + 1]``.
    ``power`` is at least 4.
    """
    none = np.zeros(0, np.int64)
    if not len(words):
        return none, none, none
    grammar = Grammar(words, bounds)
    rule, start, end, period = _crossing(words, grammar, Residues(words), least, power)
    if not len(rule):
        return none, none, none
    # All places of the rules that hold something.
    holds = np.zeros(grammar.rules, bool)
    holds[rule] = True
    here = np.flatnonzero(holds[grammar.place_rule])
    here = here[np.argsort(grammar.place_rule[here], kind="stable")]
    owner = grammar.place_rule[here]
    low, many = np.searchsorted(owner, rule), np.searchsorted(owner, rule, "right") - np.searchsorted(owner, rule)
    shift = grammar.place[here][ragged(low, many)] - np.repeat(grammar.first[rule], many)
    start, end, period = _maximal(np.repeat(start, many) + shift, np.repeat(end, many) + shift, np.repeat(period, many), len(words))
    # Word by word: nothing that the residues found may be false.
    size = end - start - period
    at = ragged(start, size)
    wrong = np.flatnonzero(words[at] != words[at + np.repeat(period, size)])
    if len(wrong):
        docs = np.unique(np.searchsorted(bounds, at[wrong], "right") - 1)
        keep = ~np.isin(np.searchsorted(bounds, start, "right") - 1, docs)
        again = [np.array(plain_runs(words[bounds[d] : bounds[d + 1]], least, power), np.int64).reshape(-1, 3) + [bounds[d], bounds[d], 0] for d in docs]
        both = np.concatenate((np.stack((start, end, period), 1)[keep], *again))
        start, end, period = both[np.lexsort((both[:, 2], both[:, 0]))].T
    return start, end, period


_RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def _detect(least: int, power: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = string_bytes(batch.column("text"))
            for a, b in slices(offsets, SLICE_BYTES):
                yield _slice(batch.slice(a, b - a), data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], least, power)

    return run


def _slice(batch: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray, least: int, power: int) -> pa.RecordBatch:
    starts, ends = run_bounds(~is_space(data), offsets)
    bounds = np.searchsorted(starts, offsets)
    ids = np.unique(span_keys(data, starts, ends), return_inverse=True)[1]
    start, end, period = find_runs(ids, bounds, least, power)
    first = np.searchsorted(start, bounds)
    doc = np.searchsorted(bounds, start, "right") - 1
    # Words after a run's first period are dropped.
    change = np.zeros(len(ids) + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, end, -1)
    kept = np.flatnonzero(np.cumsum(change[:-1]) == 0)
    size = ends[kept] - starts[kept] + 1
    joined = np.concatenate((data, [np.uint8(32)]))[np.minimum(ragged(starts[kept], size), len(data))]
    stops = np.cumsum(size)
    joined[stops - 1] = 32
    # Every document's words end with a space more, which is left out.
    many = np.diff(np.searchsorted(kept, bounds))
    last = stops[np.cumsum(many)[many > 0] - 1] - 1
    keep = np.ones(len(joined), bool)
    keep[last] = False
    length = np.zeros(len(many), np.int64)
    length[many > 0] = np.diff(last, prepend=-1) - 1
    edges = np.concatenate(([0], np.cumsum(length)))
    collapsed = pa.Array.from_buffers(pa.large_string(), len(many), [None, pa.py_buffer(edges), pa.py_buffer(joined[keep])])
    values = pa.StructArray.from_arrays(
        [pa.array(start - bounds[doc]), pa.array(end - start), pa.array(period)], ["start", "length", "period"]
    )
    runs = pa.ListArray.from_arrays(pa.array(first, pa.int32()), values)
    return pa.RecordBatch.from_arrays(
        [*batch.drop_columns("text").columns, pa.array(np.diff(bounds)), runs, collapsed.cast(pa.string())],
        [*(c for c in batch.schema.names if c != "text"), "n_words", "runs", "collapsed"],
    )


def detect(documents: DataFrame, least: int = LEAST_WORDS, power: int = LEAST_PERIODS) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` of ``documents(doc_id, text)``.

    ``runs`` are by start, then period; ``collapsed`` is the text's words, the
    repetitions after every run's first period left out, with single spaces.
    """
    if power < 4:
        raise ValueError("a run has at least 4 periods: a side of a boundary must hold two")
    return documents.select("doc_id", "text").mapInArrow(
        _detect(least, power), f"doc_id long, n_words long, runs {_RUNS}, collapsed string"
    )


def strongest(runs: Column) -> Column:
    """The run with most periods, the first of them among equals; NULL without runs."""
    return F.aggregate(
        runs, F.get(runs, F.lit(0)),
        lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best),
    )


def summary(detected: DataFrame) -> DataFrame:
    """Counts, the strongest run and digests of detected runs."""
    best = strongest(F.col("runs"))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return detected.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.floor(F.col("best.length") * 1000 / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


SPACES = r"[\x20\x09-\x0D]+"


def planted(documents: DataFrame) -> DataFrame:
    """A tenth of the texts, by the crc32 of doc_id, with words repeated from one place on.

    A NULL doc_id has no crc and is never changed.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split("text", SPACES), lambda w: w != "")
    n = F.size("words")
    a = F.pmod(F.col("g"), n).cast("int")
    p = (F.lit(1) + F.floor((n - F.col("a")) / (F.lit(3) + F.col("g") % 8))).cast("int")
    moved = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.get("words", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))),
    )
    rows = documents.select("doc_id", "text", g.alias("g"), F.when((h % 10 == 0) & F.col("text").isNotNull(), words).alias("words"))
    rows = rows.withColumn("words", F.when(n > 0, F.col("words"))).withColumn("a", F.when(n > 0, a)).withColumn("p", p)
    return rows.select("doc_id", F.when(F.col("words").isNotNull(), F.array_join(moved, " ")).otherwise(F.col("text")).alias("text"))
