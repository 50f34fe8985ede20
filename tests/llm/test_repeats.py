"""Runs of words against a search period by period, on drawn sequences and on odd texts."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from veritally.llm import repeats

SF = "/root/testdata/sf0.001"
WORD = r"[^\x20\x09-\x0d]+"


def compare(docs):
    ids = np.concatenate(docs).astype(np.int64)
    bounds = np.concatenate(([0], np.cumsum([len(d) for d in docs]))).astype(np.int64)
    got = list(zip(*(x.tolist() for x in repeats.find_runs(ids, bounds))))
    want = [(a + bounds[i], b + bounds[i], q) for i, d in enumerate(docs) for a, b, q in repeats.plain_runs(d)]
    assert got == sorted(want, key=lambda r: (r[0], r[2]))
    return len(want)


def repeated(rng, n, kinds):
    words = rng.integers(0, kinds, n)
    a = int(rng.integers(0, n))
    p = 1 + (n - a) // int(rng.integers(3, 11))
    out = words.copy()
    out[a:] = words[a + (np.arange(a, n) - a) % p]
    return out


def test_runs_of_drawn_sequences():
    rng, found = np.random.default_rng(1), 0
    for _ in range(600):
        docs = []
        for _ in range(rng.integers(1, 6)):
            n, kinds = int(rng.integers(0, 60)), int(rng.integers(1, 4))
            docs.append(repeated(rng, n, kinds) if n and rng.random() < 0.5 else rng.integers(0, kinds, n))
        found += compare(docs + docs[: rng.integers(0, 3)])
    assert found > 500
    for _ in range(5):
        compare([repeated(rng, int(rng.integers(500, 4_000)), 50), rng.integers(0, 2, 1_000), np.zeros(3_000, int)])


def test_runs_of_words_with_many_squares():
    fibonacci = [[0], [0, 1]]
    while len(fibonacci[-1]) < 3_000:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    parity = np.array([bin(i).count("1") % 2 for i in range(4_096)])
    compare([np.array(fibonacci[-1]), parity, np.tile(parity[:64], 9), np.repeat(parity[:300], 7)])


def test_least_length_and_power():
    assert repeats.plain_runs(np.zeros(5, int)) == [] and repeats.plain_runs(np.zeros(6, int)) == [(0, 6, 1)]
    assert repeats.plain_runs(np.array([1, 2] * 4)) == [(0, 8, 2)] and repeats.plain_runs(np.array([1, 2] * 3 + [1])) == []
    with pytest.raises(ValueError):
        repeats.detect(None, power=3)


def test_false_equalities_are_searched_again(monkeypatch):
    """With residues that tell little apart, results stay the same."""
    monkeypatch.setattr(repeats, "PRIMES", (3, 5))
    rng = np.random.default_rng(2)
    repeats.worker_cache().clear()
    for _ in range(60):
        compare([repeated(rng, 80, 4), rng.integers(0, 3, 60)])
    repeats.worker_cache().clear()


def rebuilt(doc_id, text):
    words = re.findall(WORD, text or "")
    if doc_id is None or not words:
        return words
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def brute(doc_id, text):
    words = rebuilt(doc_id, text)
    number = {}
    runs = repeats.plain_runs(np.array([number.setdefault(w, len(number)) for w in words], np.int64))
    runs.sort(key=lambda r: (r[0], r[2]))
    dropped = {i for a, b, q in runs for i in range(a + q, b)}
    best = min(runs, key=lambda r: (-Fraction(r[1] - r[0], r[2]), r[0], r[2])) if runs else None
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    four = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
    return (
        doc_id, len(runs), *four, sha("".join(f"{a},{b - a},{q}\n" for a, b, q in runs)),
        sha(" ".join(w for i, w in enumerate(words) if i not in dropped)),
    )


def test_query_against_plain_search(spark):
    rng = random.Random(4)
    texts = [None, "", " \t\n", "one", "a b a b a b a b", "x " * 3_000, "w\x0bv\x0cw v " * 9, "日本 語 " * 40, "A a " * 5, "y" * 9_000]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 90))) for _ in range(120)]
    texts += [" ".join(rng.choice("ab") for _ in range(4_000)), "k1 k2 k3 " * 400_000]
    rows = [(i, t, "extra", "extra") for i, t in enumerate(texts)] + [(None, "q " * 30, None, None), (None, None, None, None)]
    rows += [rows[5], rows[5]]
    given = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id + 1000000 AS doc_id", "text")
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, collapsed string").unionByName(given, allowMissingColumns=True)
    # The long text of three words has too many periods for a search one by one.
    long_id = len(texts) - 1
    some = docs.where(f"doc_id IS NULL OR doc_id <> {long_id}")
    got = sorted(map(tuple, repeats.summary(repeats.detect(repeats.planted(some))).collect()), key=repr)
    assert got == sorted((brute(r.doc_id, r.text) for r in some.collect()), key=repr)
    assert sum(r[1] for r in got) > 100
    alone = repeats.detect(docs.where(f"doc_id = {long_id}")).first()
    assert [tuple(r) for r in alone.runs] == [(0, 1_200_000, 3)] and alone.collapsed == "k1 k2 k3"
    assert repeats.summary(repeats.detect(repeats.planted(docs.limit(0)))).count() == 0
