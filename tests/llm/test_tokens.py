"""Token files and pieces against the libraries; codes by their defining properties."""

import heapq
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from veritally.llm import pieces, token_files
from veritally.llm.common import string_bytes

public_tokenizers = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
ALPHABET = [" ", "  ", "\n", "\n\n", "a", "The", "it's", " 12", "é", "日本", " ", "　", " ", "<|endoftext|>", ".", "!", "\t",
            "\r\n", "x", "\x1c", "\x00", "\U0001F600", "​", "'s ", "'", "▁", "aaa", "ing "]


def texts(n=3_000, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 30))) for _ in range(n)] + ["", "a" * 700, "é" * 300]


@pytest.fixture(scope="module")
def documents(spark):
    given = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    more = [(10_000 + i, t) for i, t in enumerate(texts(300))] + [(20_000, None), (20_000, "again"), (None, "no id")]
    return given.union(spark.createDataFrame(more, "doc_id long, text string"))


def huffman_cost(counts):
    heap = [(int(c), i) for i, c in enumerate(counts) if c]
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        cost += a[0] + b[0]
        heapq.heappush(heap, (a[0] + b[0], -1))
    return cost


def best_limited_cost(counts, limit):
    """Smallest cost over all length lists with a full Kraft sum, by search."""
    counts = sorted((int(c) for c in counts if c), reverse=True)

    def search(i, room, shortest):
        if i == len(counts):
            return 0
        out = float("inf")
        for length in range(shortest, limit + 1):
            left = room - 2 ** (limit - length)
            if left >= len(counts) - i - 1:
                out = min(out, counts[i] * length + search(i + 1, left, length))
        return out

    return search(0, 2**limit, 1)


def test_code_lengths_are_optimal():
    rng = np.random.default_rng(0)
    for _ in range(40):
        counts = np.where(rng.random(300) < 0.7, (rng.pareto(0.6, 300) * 10).astype(np.int64) + 1, 0)
        lengths = token_files.code_lengths(counts, 30)
        assert (lengths[counts == 0] == 0).all() and (counts * lengths).sum() == huffman_cost(counts)
    for _ in range(30):
        counts = (rng.pareto(0.4, 7) * 10).astype(np.int64) + 1
        for limit in (3, 4, 5):
            lengths = token_files.code_lengths(counts, limit).astype(int)
            assert lengths.max() <= limit and sum(2.0 ** -l for l in lengths if l) <= 1
            assert (counts * lengths).sum() == best_limited_cost(counts, limit)
    with pytest.raises(ValueError):
        token_files.code_lengths(np.ones(20, np.int64), 4)
    assert token_files.code_lengths(np.array([0, 0, 9])).tolist() == [0, 0, 1]


@pytest.mark.parametrize("kinds, limit", [(1, 16), (2, 16), (300, 16), (40_000, 16), (60_000, 18)])
def test_blocks_round_trip(kinds, limit):
    rng = np.random.default_rng(kinds)
    ids = np.minimum((rng.pareto(0.7, 20_011) * 3).astype(np.int64), kinds - 1)
    ids[:kinds] = np.arange(kinds)[: len(ids)]
    code = token_files.Code(token_files.code_lengths(np.bincount(ids, minlength=kinds + 5), limit), limit)
    used = np.flatnonzero(code.lengths)
    # Canonical: shorter codes first, ids in order within a length, none a prefix of another.
    order = sorted(used, key=lambda i: (code.lengths[i], i))
    words = [format(int(code.codes[i]), f"0{code.lengths[i]}b") for i in order]
    assert words == sorted(words) and not any(b.startswith(a) for a, b in zip(words, words[1:]))
    for n in (0, 1, 63, 64, 65, 20_011):
        bits, marks = code.encode(ids[:n])
        assert len(marks) == 2 * -(-n // token_files.STRIDE) and len(bits) == -(-int(code.lengths[ids[:n]].sum()) // 8)
        assert (code.decode(bits, marks, n) == ids[:n]).all()


def test_token_ids_are_the_library_s(documents):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    encoder = token_files.Pieces(path)
    for some in (texts(6_000, 2), texts(3_000, 3)):
        data, offsets = string_bytes(pa.array(some))
        ids, bounds = encoder.encode(data, offsets)
        for i, t in enumerate(some):
            assert ids[bounds[i] : bounds[i + 1]].tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)

    code = token_files.fit(documents, path)
    out = token_files.read(token_files.write(documents, path, code), code, with_ids=True).orderBy("start").collect()
    rows = sorted(documents.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] is not None, r["text"] or ""))
    at = 0
    for r, want in zip(out, rows, strict=True):
        ids = library.encode(want["text"] or "", add_special_tokens=False).ids + [0]
        raw = np.array(ids, "<u4").tobytes()
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"], r["ids"]) == (want["doc_id"], at, len(ids), zlib.crc32(raw), ids)
        at += len(ids)


def test_token_files_of_nothing(documents):
    assert token_files.token_files(documents.limit(0), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


@pytest.fixture(scope="module")
def model_file():
    return public_tokenizers.path("piece_bpe_32k.model")


def test_pieces_are_the_library_s(spark, documents, model_file):
    library = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=model_file)
    extra = documents.withColumn("ids", documents["text"]).withColumn("keep", documents["doc_id"])
    out = pieces.encode(extra, pieces.load(model_file)).collect()
    assert len(out) == documents.count()
    for r in out:
        text = r["text"] or ""
        ids = library.encode(text)
        assert r["ids"] == ids and r["n_ids"] == len(ids) and r["keep"] == r["doc_id"], repr(text[:80])
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        assert r["decoded_crc32"] == zlib.crc32(library.decode(ids).encode())
        assert r["round_trip"] == (library.decode(ids) == text) and (r["round_trip"] or "▁" in text)
    assert pieces.encode(documents.limit(0), pieces.load(model_file), keep_ids=False).count() == 0


def test_unigram_walk_is_the_best_sum(model_file):
    """The same pieces as a unigram model: no segmentation has a larger sum of scores."""
    model = pieces.load(model_file)
    model.algorithm = pieces.UNIGRAM
    rng = random.Random(7)
    model.scores = [-rng.random() * 12 - 1 for _ in model.scores]
    encoder = pieces.Encoder(model)
    some = [t for t in texts(400, 5) if t]
    ids, bounds = encoder.encode(some)
    for i, t in enumerate(some):
        full = ("▁" + t).replace(" ", "▁")
        best = [0.0] + [-np.inf] * len(full)
        for end in range(1, len(full) + 1):
            for start in range(max(0, end - encoder.longest), end):
                k = encoder.text.get(full[start:end])
                value = model.scores[k] if k is not None else encoder.lowest - pieces.UNKNOWN_PENALTY if end - start == 1 else -np.inf
                best[end] = max(best[end], best[start] + value)
        own = ids[bounds[i] : bounds[i + 1]]
        strange = sum(c not in encoder.text for c in full)
        got = sum(model.scores[k] for k in own if model.kinds[k] == pieces.NORMAL) + strange * (encoder.lowest - pieces.UNKNOWN_PENALTY)
        assert got == pytest.approx(best[-1]), repr(t)
    assert encoder.decode(ids, bounds) == [t.replace("▁", " ") for t in some]
