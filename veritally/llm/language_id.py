"""Language identification by interpolated Kneser-Ney character models.

One 5-character model per language, kept as sorted hash arrays.  A text gets
the language of lowest cross-entropy per character; texts that no model
explains are marked ``rejected`` with limits calibrated on further labelled
texts.

Counting the sample's character sequences is a Spark aggregation.  What
reaches the driver and the tasks is bounded by ``sample_chars``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import HashTable, Shipped, crc_mod, mix64, narrow_batches, run_sums, stored, unit_hash, worker_cache

ORDER = 5
PAD = ORDER - 1
DISCOUNT = 0.75
# Most characters of labelled text, over all languages, that the models and
# the limits of one batch of languages are fitted on (a hash sample of whole
# documents), and languages whose models are in memory together.
SAMPLE_CHARS = 2_000_000
CALIBRATION_CHARS = 1_000_000
BATCH_LANGUAGES = 64
# Deviations above a language's usual cross-entropy at which a text is rejected: as many as keep
# this share of the language's calibration texts, within bounds; the most for a few such texts.
KEEP_SHARE = 0.995
LEAST_DEVIATIONS, MOST_DEVIATIONS = 3.0, 6.0
FEW_TEXTS = 20
# Characters scored at once: the arrays then stay in the processor's cache.
SLICE_CHARS = 1 << 17


def _letters() -> np.ndarray:
    cache = worker_cache()
    if "letters" not in cache:
        cache["letters"] = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return cache["letters"]


def _sequence(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lowered letters with single spaces between words, each text after
    ``PAD`` spaces.  Returns code points, bounds, and letters per text."""
    low = [" " * PAD + t.lower() for t in texts]
    sizes = np.fromiter(map(len, low), np.int64, len(low))
    codes = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    letter = _letters()[codes]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    first = bounds[:-1, None] + np.arange(PAD)
    keep[first.ravel()] = True
    # The space right after the padding would repeat it.
    after = first[:, -1] + 1
    after = after[after < bounds[1:]]
    keep[after[~letter[after]]] = False
    kept = np.concatenate(([0], np.cumsum(keep)))
    return np.where(letter, codes, 32)[keep].astype(np.uint64), kept[bounds], run_sums(letter.astype(np.int64), bounds)


def _grams(codes: np.ndarray, order: int = ORDER) -> list[np.ndarray]:
    """Hashes of the sequences of 1 .. order characters that end at each place."""
    own = mix64(codes + np.uint64(0x1234567))
    out, running = [], np.zeros(len(codes), np.uint64)
    for n in range(order):
        factor = np.uint64(int(mix64(np.array([n + 77], np.uint64))[0]) | 1)
        running = running.copy()
        running[n:] += own[: len(own) - n] * factor
        out.append(mix64(running + np.uint64(n)))
    return out


def _predicted(bounds: np.ndarray, n: int) -> np.ndarray:
    """Places that are no padding."""
    yes = np.ones(n, bool)
    yes[(bounds[:-1, None] + np.arange(PAD)).ravel()] = False
    return yes


def _count_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for lang, rows in pdf.groupby("lang"):
            codes, bounds, _ = _sequence(rows["text"].tolist())
            at = np.flatnonzero(_predicted(bounds, len(codes)))
            _, first, count = np.unique(_grams(codes)[-1][at], return_index=True, return_counts=True)
            chars = codes[at[first][:, None] + np.arange(-PAD, 1)].astype("<u4")
            grams = [r.tobytes().decode("utf-32-le", "surrogatepass") for r in chars]
            yield pd.DataFrame({"lang": lang, "gram": grams, "n": count})


class Models:
    """All languages' models over the union of their character sequences.

    ``tables[n]`` holds the sorted hashes of the (n + 1)-character sequences,
    ``logp[n]`` their interpolated log-probability per language, ``back[n]``
    the log of the weight given to shorter contexts after that sequence.
    """

    def __init__(self, counts: pd.DataFrame, characters: int | None = None):
        self.langs = sorted(counts["lang"].unique().tolist())
        self.keys: list[np.ndarray] = []
        self.logp: list[np.ndarray] = []
        self.back: list[np.ndarray] = []
        self.mean = np.zeros(len(self.langs))
        self.spread = np.ones(len(self.langs))
        self.noise = np.ones(len(self.langs))
        self.deviations = np.full(len(self.langs), MOST_DEVIATIONS)
        self._tables = None
        if self.langs:
            self._estimate(counts, characters)

    def _estimate(self, counts: pd.DataFrame, characters: int | None) -> None:
        L = len(self.langs)
        code = {lang: i for i, lang in enumerate(self.langs)}
        gram = np.frombuffer("".join(counts["gram"]).encode("utf-32-le", "surrogatepass"), np.uint32)
        gram = gram.reshape(-1, ORDER).astype(np.uint64)
        lang = counts["lang"].map(code).to_numpy()
        union, inverse = np.unique(gram, axis=0, return_inverse=True)
        level = np.zeros((len(union), L))
        np.add.at(level, (inverse.ravel(), lang), counts["n"].to_numpy(float))
        shapes, values = [union], [level]
        # Shorter sequences count the different characters seen before them.
        for _ in range(ORDER - 1):
            longer, seen = shapes[0], values[0] > 0
            union, inverse = np.unique(longer[:, 1:], axis=0, return_inverse=True)
            level = np.zeros((len(union), L))
            np.add.at(level, inverse.ravel(), seen.astype(float))
            shapes.insert(0, union)
            values.insert(0, level)
        # Different characters of all batches, so that their models compare.
        characters = characters or len(shapes[0])
        hashes = [_grams(s.ravel())[n][n :: n + 1] for n, s in enumerate(shapes)]
        prob, weight = [], []
        for n, (shape, c) in enumerate(zip(shapes, values)):
            if n == 0:
                inverse, contexts = np.zeros(len(shape), np.int64), 1
                lower = np.full((len(shape), L), 1.0 / (characters + 1))
            else:
                ctx, inverse = np.unique(shape[:, :-1], axis=0, return_inverse=True)
                inverse, contexts = inverse.ravel(), len(ctx)
                lower = prob[n - 1][_rows(shapes[n - 1], shape[:, 1:])]
            total, kinds = np.zeros((contexts, L)), np.zeros((contexts, L))
            np.add.at(total, inverse, c)
            np.add.at(kinds, inverse, (c > 0).astype(float))
            gamma = np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1.0)
            direct = np.where(c > 0, np.maximum(c - DISCOUNT, 0) / np.maximum(total, 1)[inverse], 0.0)
            prob.append(direct + gamma[inverse] * lower)
            if n == 0:
                self.unseen = np.log(gamma[0] / (characters + 1)).astype(np.float32)
            else:
                # A context may be absent as a sequence (padding): it gets a row of its own.
                weight.append((ctx, gamma))
        for n in range(ORDER):
            logp = np.log(prob[n]).astype(np.float32)
            order = np.argsort(hashes[n])
            self.keys.append(hashes[n][order])
            self.logp.append(logp[order])
        for n, (ctx, gamma) in enumerate(weight):
            h = _grams(ctx.ravel())[n][n :: n + 1]
            order = np.argsort(h)
            self.back.append((h[order], np.log(gamma).astype(np.float32)[order]))

    def calibrate(self, i: int, h: np.ndarray, n: np.ndarray) -> None:
        """Limits of a language from cross-entropies ``h`` of texts of ``n`` characters.

        Medians, so that junk among the texts does not widen the limits.
        """
        long = n >= 200
        self.mean[i] = np.median(h[long] if long.any() else h)
        apart = np.abs(h - self.mean[i])
        if long.any():
            self.spread[i] = max(1.4826 * np.median(apart[long]), 0.05)
        else:
            self.spread[i] = 0.05
        # Around the language's mean: what is left is the scatter of short texts and not that of their lengths.
        if not long.all():
            self.noise[i] = max(1.4826 * np.median((apart * np.sqrt(n))[~long]), 1.0)
        if len(h) >= FEW_TEXTS:
            far = (h - self.mean[i]) / np.sqrt(self.spread[i] ** 2 + self.noise[i] ** 2 / n)
            self.deviations[i] = np.clip(np.quantile(far, KEEP_SHARE), LEAST_DEVIATIONS, MOST_DEVIATIONS)

    def _open(self):
        if self._tables is None:
            self._tables = [HashTable(k) for k in self.keys], [(HashTable(h), g) for h, g in self.back]
        return self._tables

    def __getstate__(self):
        return {**self.__dict__, "_tables": None}

    def surprisal(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(per language and text: sum of -log p; predicted characters; letters)."""
        codes, bounds, letters = _sequence(texts)
        grams = _grams(codes)
        tables, backs = self._open()
        rows = np.repeat(np.arange(len(texts)), np.diff(bounds))
        out = np.zeros((len(texts), len(self.langs)))

        def add(at, values):
            # ``at`` is ascending, so every text is one run.
            if len(at):
                first = np.flatnonzero(np.diff(rows[at], prepend=-1))
                out[rows[at[first]]] += np.add.reduceat(values, first, axis=0, dtype=np.float64)

        left = np.flatnonzero(_predicted(bounds, len(codes)))
        for n in range(ORDER - 1, -1, -1):
            found = tables[n].find(grams[n][left])
            hit = found >= 0
            add(left[hit], self.logp[n][found[hit]])
            left = left[~hit]
            if n == 0:
                add(left, np.broadcast_to(self.unseen, (len(left), len(self.langs))))
            elif len(left):
                table, gamma = backs[n - 1]
                at = table.find(grams[n - 1][left - 1])
                known = at >= 0
                add(left[known], gamma[at[known]])
        return -out, np.diff(bounds) - PAD, letters


def _rows(table: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Row numbers of ``wanted`` in a lexicographically sorted ``table`` that holds them all."""
    n = table.shape[1]
    a, b = _grams(table.ravel())[n - 1][n - 1 :: n], _grams(wanted.ravel())[n - 1][n - 1 :: n]
    order = np.argsort(a)
    return order[np.searchsorted(a[order], b)]


def fit(labelled: DataFrame, sample_chars: int = SAMPLE_CHARS, calibration_chars: int = CALIBRATION_CHARS) -> list[Models]:
    """Models from ``labelled(doc_id, text, lang)``; rows without text or language are left out.

    Every language has a model, ``BATCH_LANGUAGES`` of them to an element.
    Each gets an equal share of its batch's ``sample_chars``: a hash sample of
    its whole documents, one at least.  Limits come from a disjoint sample.
    """
    spark = labelled.sparkSession
    rows = labelled.select("doc_id", "text", "lang").where("text IS NOT NULL AND lang IS NOT NULL AND text <> ''")
    rows = rows.withColumn("u", unit_hash("doc_id", "text", salt="lang"))
    sizes = rows.groupBy("lang").agg(F.sum(F.length("text")).alias("n"), F.min("u").alias("u")).collect()
    sizes.sort(key=lambda r: r["lang"])
    if not sizes:
        return []
    share = sample_chars / min(len(sizes), BATCH_LANGUAGES)
    more = calibration_chars / min(len(sizes), BATCH_LANGUAGES)
    step = 1.0 / (1 << 30)
    parts = [
        (k // BATCH_LANGUAGES, r["lang"],
         max(r["u"] + step, min(1.0, share / r["n"]) * (1.0 if share + more <= r["n"] else share / (share + more))),
         min(1.0, (share + more) / r["n"])) for k, r in enumerate(sizes)
    ]
    parts = spark.createDataFrame(parts, "batch int, lang string, upto double, beyond double")
    # One row per language is broadcast.
    picked = rows.join(F.broadcast(parts), "lang").where("u < upto OR u < beyond")
    picked = stored(picked.select("batch", "lang", "text", (F.col("u") < F.col("upto")).alias("train")), "sample")
    counts = (
        picked.where("train").select("lang", "text").mapInPandas(_count_grams, "lang string, gram string, n long")
        .groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    )
    counts = stored(counts.join(F.broadcast(parts.select("lang", "batch")), "lang"), "grams")
    batches = range((len(sizes) - 1) // BATCH_LANGUAGES + 1)
    characters = None
    if len(batches) > 1:
        characters = counts.select(F.substring("gram", -1, 1)).distinct().count()
    fitted = (
        _fit_batch(counts.where(F.col("batch") == k), picked.where((F.col("batch") == k) & ~F.col("train")), characters) for k in batches
    )
    return [m for m in fitted if m.langs]


def _fit_batch(counts: DataFrame, unseen: DataFrame, characters: int | None) -> Models:
    models = Models(counts.select("lang", "gram", "n").toPandas(), characters)
    if not models.langs:
        return models
    shipped = Shipped(counts.sparkSession, models)

    def measure(batches):
        m = shipped.get()
        for pdf in batches:
            total, n, _ = m.surprisal(pdf["text"].tolist())
            own = pdf["lang"].map({x: i for i, x in enumerate(m.langs)}).fillna(-1).to_numpy(int)
            ok = (own >= 0) & (n > 0)
            h = total[np.flatnonzero(ok), own[ok]] / n[ok]
            yield pd.DataFrame({"lang": pdf["lang"][ok], "h": h, "n": n[ok]})

    seen = unseen.select("lang", "text").mapInPandas(measure, "lang string, h double, n long")
    # At most calibration_chars numbers.
    for lang, g in seen.toPandas().groupby("lang"):
        models.calibrate(models.langs.index(lang), g["h"].to_numpy(float), g["n"].to_numpy(float))
    return models


ADDED = "lang_pred string, score double, rejected boolean, bits_per_char double"


def identify(docs: DataFrame, models: Models | list[Models]) -> DataFrame:
    """``docs`` plus ``lang_pred``, ``score``, ``rejected`` and ``bits_per_char``.

    Only ``text`` is looked at.  NULL and letterless texts give ``und``, score
    0 and ``rejected``; without any model every text does.  Equal scores go to
    the language first in order.  Columns of the input with these names are
    replaced.  Further batches of languages are a pass each over written rows,
    so that a task holds one batch's models.
    """
    names = [c.split()[0] for c in ADDED.split(", ")]
    out = docs.select([c for c in docs.columns if c not in names])
    narrow_batches(docs.sparkSession)
    models = [models] if isinstance(models, Models) else models or [Models(pd.DataFrame({"lang": [], "gram": [], "n": []}))]
    for k, batch in enumerate(models):
        out = _identify(out if k == 0 else stored(out, "languages"), batch, k > 0)
    return out


def _identify(docs: DataFrame, models: Models, again: bool) -> DataFrame:
    """One batch of languages; ``again`` if ``docs`` has the best of earlier batches."""
    names = [c.split()[0] for c in ADDED.split(", ")]
    base = [f for f in docs.schema.fields if f.name not in names]
    shipped = Shipped(docs.sparkSession, models)
    schema = T.StructType(base + T._parse_datatype_string(ADDED).fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.get()
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            n = len(texts)
            if again:
                had = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in names]
                best, score, rejected = np.array(had[0], object), np.array(had[1], float), np.array(had[2], bool)
                bits = np.array([np.nan if x is None else x for x in had[3]], float)
            else:
                best, score = np.full(n, "und", object), np.zeros(n)
                bits, rejected = np.full(n, np.nan), np.ones(n, bool)
            for rows in _text_slices(texts, SLICE_CHARS):
                if not m.langs:
                    break
                total, size, letters = m.surprisal([texts[i] for i in rows])
                ok = letters > 0
                rows, total, size = rows[ok], total[ok], size[ok]
                if not len(rows):
                    continue
                h = total / size[:, None]
                pick = h.argmin(1)
                low = h[np.arange(len(rows)), pick]
                weight = np.minimum(size, 50)
                odds = np.exp(-(h - low[:, None]) * weight[:, None]).sum(1)
                limit = np.sqrt(m.spread[pick] ** 2 + m.noise[pick] ** 2 / size) * m.deviations[pick]
                far = low > m.mean[pick] + limit
                # Against the best of earlier batches, whose languages come first in order.
                before = bits[rows] * np.log(2)
                new = ~(before <= low)
                seen = ~np.isnan(before)
                top = np.where(new, low, before)
                odds = odds * np.exp(-(low - top) * weight)
                odds[seen] += np.exp(-(before - top) * weight)[seen] / np.maximum(score[rows][seen], 1e-300)
                score[rows] = 1.0 / odds
                at = rows[new]
                best[at], bits[at], rejected[at] = np.array(m.langs, object)[pick[new]], low[new] / np.log(2), far[new]
            more = [pa.array(best.tolist(), pa.string()), pa.array(score), pa.array(rejected),
                    pa.array(bits, mask=np.isnan(bits))]
            kept = [f.name for f in base]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in kept] + more, kept + names)

    return docs.mapInArrow(run, schema)


def _text_slices(texts: list, limit: int) -> Iterator[np.ndarray]:
    """Row numbers of non-NULL texts, about ``limit`` characters at a time."""
    rows, size = [], 0
    for i, t in enumerate(texts):
        if t is None:
            continue
        rows.append(i)
        size += len(t) + PAD
        if size >= limit:
            yield np.array(rows)
            rows, size = [], 0
    if rows:
        yield np.array(rows)


def language_id(documents: DataFrame) -> DataFrame:
    """``identify`` with models learned from the rows of ``documents`` whose
    crc32(doc_id) modulo 4 is not 2; those others are ``held_out``."""
    held = crc_mod("doc_id", 4) == 2
    models = fit(documents.where(~held))
    return identify(documents.select("doc_id", "text", held.alias("held_out")), models).select(
        "doc_id", "held_out", "lang_pred", "score", "rejected", "bits_per_char"
    )
