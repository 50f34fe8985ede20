"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  A sentence's probability is a logistic
function of its words; the document's is the noisy-or of its sentences,
``1 - prod(1 - p)``, so one offending sentence is enough.  Weights are
trained from document labels alone, and then point at the sentences.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import HashTable, Shipped, crc_mod, narrow_batches, run_sums, slices, string_bytes, unit_hash, worker_cache
from .text import run_bounds, span_hashes

# Most labelled documents of each class, a hash sample, that the weights are fitted on.
SAMPLE_PER_CLASS = 4_000
# A word that fewer sampled documents hold gets no weight.
LEAST_DOCUMENTS = 8
STEPS = 120
RATE = 0.15
# Absolute-value penalty that picks the words, in shares of the weighted
# sample; the picked ones are then fitted again with a small square penalty.
PICK_PENALTY = 2e-4
LEAST_PICKED = 0.5
REFIT_PENALTY = 2e-6
ENDS = np.frombuffer(b".!?\n", np.uint8)


def _kinds() -> tuple[np.ndarray, np.ndarray]:
    cache = worker_cache()
    if "kinds" not in cache:
        b = np.arange(256)
        word = (b >= 128) | ((b >= 65) & (b <= 90)) | ((b >= 97) & (b <= 122))
        end = np.isin(b, ENDS)
        cache["kinds"] = word, end
    return cache["kinds"]


def bags(data: np.ndarray, offsets: np.ndarray):
    """Words (maximal runs of letters) and sentences of a slice of texts.

    Returns every word's hash, the bounds of sentences in words and in bytes,
    and the bounds of documents in sentences.
    """
    word, end = _kinds()
    starts, ends = run_bounds(word[data], offsets)
    feature = span_hashes(data, starts, ends)
    s_from, s_to = run_bounds(~end[data], offsets)
    inside = np.searchsorted(starts, s_from), np.searchsorted(starts, s_to)
    full = inside[0] < inside[1]
    s_from, s_to = s_from[full], s_to[full]
    word_bounds = np.concatenate((inside[0][full], [len(starts)]))
    return feature, word_bounds, s_from, s_to, np.searchsorted(s_from, offsets)


def _bag_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every word's sentence and hash, packed per document."""
    for batch in batches:
        data, offsets = string_bytes(batch.column("text"))
        packed, counts = [], []
        for a, b in slices(offsets):
            part = offsets[a : b + 1] - offsets[a]
            feature, wb, _, _, docs = bags(data[offsets[a] : offsets[b]], part)
            sentence = np.repeat(np.arange(len(wb) - 1), np.diff(wb))
            for d in range(b - a):
                w = slice(wb[docs[d]], wb[docs[d + 1]])
                packed.append((sentence[w] - docs[d]).astype("<u4").tobytes() + feature[w].astype("<u8").tobytes())
                counts.append(int(docs[d + 1] - docs[d]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("toxic"), batch.column("weight"), pa.array(counts, pa.int64()), pa.array(packed, pa.binary())],
            ["toxic", "weight", "sentences", "packed"],
        )


@dataclass
class Weights:
    """Sorted word hashes, their weights, and the bias of every sentence."""

    words: np.ndarray
    values: np.ndarray
    bias: float


NONE = Weights(np.zeros(0, np.uint64), np.zeros(0), -30.0)


def train(toxic: np.ndarray, weight: np.ndarray, sentences: np.ndarray, packed: list[bytes]) -> Weights:
    """Weights from bags packed by ``_bag_rows``; none unless both classes occur."""
    start = np.concatenate(([0], np.cumsum(sentences))).astype(np.int64)
    if not start[-1] or not (toxic == 1).any() or not (toxic == 0).any():
        return NONE
    parts = [(np.frombuffer(p, "<u4", len(p) // 12), np.frombuffer(p, "<u8", len(p) // 12, len(p) // 3)) for p in packed]
    sentence = np.concatenate([s.astype(np.int64) + at for (s, _), at in zip(parts, start)])
    names, feature = np.unique(np.concatenate([h for _, h in parts]), return_inverse=True)
    doc = np.repeat(np.arange(len(toxic)), sentences)
    held = np.unique(feature * np.int64(len(toxic)) + doc[sentence]) // len(toxic)
    useful = np.bincount(held, minlength=len(names)) >= LEAST_DOCUMENTS
    keep = useful[feature]
    pair = np.unique(sentence[keep] * np.int64(len(names)) + feature[keep])
    sentence, feature = pair // len(names), (np.cumsum(useful) - 1)[pair % len(names)]
    names = names[useful]
    n = int(start[-1])
    share = weight[toxic == 1].sum() / weight.sum()
    bias = np.log(max(share, 1e-4) / max(sentences.mean(), 1.0) / 4)
    weight = weight / weight.sum()

    def descend(feature, sentence, n_words, bias, absolute, square):
        w = np.zeros(n_words)
        m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
        for step in range(1, STEPS + 1):
            s = bias + np.bincount(sentence, w[feature], minlength=n)
            p = 1 / (1 + np.exp(-np.clip(s, -30, 30)))
            clean = np.exp(-run_sums(np.logaddexp(0, s), start))
            ratio = np.clip(clean / np.maximum(1 - clean, 1e-9), 0, 1e4)
            g = p * np.where(toxic == 1, -ratio, 1.0)[doc] * weight[doc]
            grad = np.bincount(feature, g[sentence], minlength=n_words)
            grad += square * w + absolute * np.where(w != 0, np.sign(w), -np.sign(grad) * np.minimum(1, np.abs(grad) / absolute) if absolute else 0)
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
            w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
            mb, vb = 0.9 * mb + 0.1 * g.sum(), 0.99 * vb + 0.01 * g.sum() ** 2
            bias -= RATE / 3 * (mb / (1 - 0.9**step)) / (np.sqrt(vb / (1 - 0.99**step)) + 1e-6)
        return w, bias

    w, _ = descend(feature, sentence, len(names), bias, PICK_PENALTY, 0.0)
    picked = np.abs(w) >= LEAST_PICKED
    if picked.any():
        keep = picked[feature]
        names = names[picked]
        feature, sentence = (np.cumsum(picked) - 1)[feature[keep]], sentence[keep]
        w, bias = descend(feature, sentence, len(names), bias, 0.0, REFIT_PENALTY)
        return Weights(names, w, float(bias))
    return Weights(names[:0], w[:0], float(bias))


def fit(documents: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Weights:
    """Weights from ``documents(doc_id, text)`` and ``labels(doc_id, toxic)``.

    A document with several labels takes the largest.  The sample's bags, at
    most about ``2 * per_class`` rows, are fitted in one task.
    """
    known = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return NONE
    share = {c: min(1.0, per_class / n) for c, n in sizes.items()}
    rate = F.when(F.col("toxic") == 1, share[1]).otherwise(share[0])
    sample = known.where(unit_hash("doc_id", salt="tox") < rate).withColumn("weight", 1 / rate)
    # At most about 2 * per_class ids are broadcast.
    texts = documents.where("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    bags = texts.select("toxic", "weight", "text").mapInArrow(
        _bag_rows, "toxic int, weight double, sentences long, packed binary"
    )

    def fit_all(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["toxic", "sentences", "packed"])
        w = train(pdf["toxic"].to_numpy(), pdf["weight"].to_numpy(), pdf["sentences"].to_numpy(), pdf["packed"].tolist())
        return pd.DataFrame({"words": [w.words.tobytes()], "w": [w.values.tobytes()], "bias": [w.bias]})

    rows = bags.groupBy(F.lit(1).alias("one")).applyInPandas(fit_all, "words binary, w binary, bias double").collect()
    if not rows:
        return NONE
    return Weights(np.frombuffer(bytes(rows[0]["words"]), np.uint64), np.frombuffer(bytes(rows[0]["w"]), np.float64), rows[0]["bias"])


ADDED = "score double, predicted int, sentences int, offending array<struct<start:int,length:int,score:double>>"


def score(docs: DataFrame, weights: Weights) -> DataFrame:
    """``docs`` plus ``score``, ``predicted`` (score of 0.5 or more),
    ``sentences`` and ``offending``: the sentences of probability 0.5 or more,
    or else the likeliest one of a predicted document, by code point.

    Only ``text`` is looked at.  NULL, empty and wordless texts have no
    sentence, score 0.  Columns of the input with these names are replaced.
    """
    names = [c.split()[0] for c in ADDED.split(", ")]
    base = docs.select([c for c in docs.columns if c not in names])
    schema = T.StructType(base.schema.fields + T._parse_datatype_string(ADDED).fields)
    narrow_batches(docs.sparkSession)
    shipped = Shipped(docs.sparkSession, weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shipped.get()
        table = HashTable(w.words)
        for batch in batches:
            data, offsets = string_bytes(batch.column("text"))
            n = batch.num_rows
            scores, counts, found = np.zeros(n), np.zeros(n, np.int32), [[] for _ in range(n)]
            for a, b in slices(offsets, 1 << 19):
                part = data[offsets[a] : offsets[b]]
                feature, wb, s_from, s_to, docs_at = bags(part, offsets[a : b + 1] - offsets[a])
                if not len(s_from):
                    continue
                place = table.find(feature)
                at = np.flatnonzero(place >= 0)
                sentence = np.searchsorted(wb, at, "right") - 1
                # A word counts once in a sentence.
                pair = np.unique(sentence * np.int64(len(w.words) + 1) + place[at])
                s = w.bias + np.bincount(pair // (len(w.words) + 1), w.values[pair % (len(w.words) + 1)], minlength=len(s_from))
                p = 1 / (1 + np.exp(-np.clip(s, -30, 30)))
                scores[a:b] = 1 - np.exp(-run_sums(np.logaddexp(0, s), docs_at))
                counts[a:b] = np.diff(docs_at)
                doc = np.repeat(np.arange(a, b), np.diff(docs_at))
                for k in np.flatnonzero(p >= 0.5):
                    found[doc[k]].append((k, s_from, s_to, p, part, offsets[doc[k]] - offsets[a]))
                for d in np.flatnonzero(scores[a:b] >= 0.5):
                    if not found[a + d]:
                        k = docs_at[d] + int(np.argmax(p[docs_at[d] : docs_at[d + 1]]))
                        found[a + d].append((k, s_from, s_to, p, part, offsets[a + d] - offsets[a]))
                for d in range(a, b):
                    found[d] = [_span(*x) for x in found[d]]
            more = [pa.array(scores), pa.array((scores >= 0.5).astype(np.int32)), pa.array(counts),
                    pa.array(found, pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("score", pa.float64())])))]
            yield pa.RecordBatch.from_arrays(batch.columns + more, batch.schema.names + names)

    return base.mapInArrow(run, schema)


def _span(k, s_from, s_to, p, part, doc_start) -> dict:
    head = part[doc_start : s_from[k]]
    body = part[s_from[k] : s_to[k]]
    return {"start": int(((head & 0xC0) != 0x80).sum()), "length": int(((body & 0xC0) != 0x80).sum()), "score": float(p[k])}


def toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``score`` with weights learned from labels of documents whose
    crc32(doc_id) modulo 5 is not 0; those others are ``held_out``."""
    held = crc_mod("doc_id", 5) == 0
    weights = fit(documents.select("doc_id", "text"), labels.where(~held))
    return score(documents.select("doc_id", "text", held.alias("held_out")), weights).drop("text")
