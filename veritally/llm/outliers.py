"""Quality rules and robust outliers.

Base rules look at counts of one text.  The method's verdict compares each
document with its language and source: a minimum-covariance-determinant
estimate of the transformed counts (concentration steps over the most central
three quarters), and rejection by Mahalanobis distance.

Every concentration step is two aggregations over a narrow written table, so
a source with most of the rows is combined before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import mix64, run_sums, slices, stored, string_bytes
from .text import is_space, run_bounds, span_hashes

WINDOW = 8
SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
FEATURES = ["x0", "x1", "x2", "x3", "x4"]
CORE = 0.75
STEPS = 4
# Fewer documents, by the number of dimensions, give no estimate of their own: such groups of a language are taken together.
LEAST_GROUP = 20 * len(FEATURES)
# Share of normal documents within the chi-square limit, and least deviations
# (in the transformed units) that a spread is taken to have: most texts have no
# symbol or repeated line at all, which is no reason to reject those with a few.
# A group at these floors rejects, by one statistic alone, beyond about 9 %
# symbols, 26 % repeated lines, 17 % repeated words, an 8-fold length or a
# 1.5-fold word length.  Lengths are skewed: 0.999 would reject plain short texts.
CONFIDENCE = 0.9999
LEAST_SPREAD = [0.4, 0.08, 0.06, 0.1, 0.08]


def counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of every text in a slice, as int64 arrays."""
    space = is_space(data)
    point = (data & 0xC0) != 0x80
    starts, ends = run_bounds(~space, offsets)
    bounds = np.searchsorted(starts, offsets)
    symbol = np.isin(data, SYMBOLS)
    out = {
        "n_words": np.diff(bounds),
        "word_chars": run_sums((point & ~space).astype(np.int64), offsets),
        "n_symbols": run_sums(symbol.astype(np.int64), offsets),
    }
    docs = len(offsets) - 1
    # Lines: runs without a line feed that hold a word.
    l_from, l_to = run_bounds(data != 10, offsets)
    full = np.searchsorted(starts, l_from) < np.searchsorted(starts, l_to)
    l_from, l_to = l_from[full], l_to[full]
    doc = np.searchsorted(offsets, l_from, "right") - 1
    key = mix64(span_hashes(data, l_from, l_to, lower=False) + mix64(doc.astype(np.uint64)))
    _, first = np.unique(key, return_index=True)
    repeat = np.ones(len(key), bool)
    repeat[first] = False
    out["n_lines"] = np.bincount(doc, minlength=docs)
    out["n_dup_lines"] = np.bincount(doc[repeat], minlength=docs)
    # Windows of words that occur twice or more in their text, and the words they cover.
    h = span_hashes(data, starts, ends, lower=False)
    n = max(len(h) - WINDOW + 1, 0)
    doc = np.repeat(np.arange(docs), out["n_words"])
    rolled = mix64(doc[:n].astype(np.uint64) + np.uint64(99))
    for j in range(WINDOW):
        rolled = rolled + mix64(h[j : j + n] + np.uint64(j)) * np.uint64(2 * j + 1)
    whole = np.flatnonzero(doc[:n] == doc[WINDOW - 1 :]) if n else np.zeros(0, np.int64)
    _, where, often = np.unique(rolled[whole], return_inverse=True, return_counts=True)
    at = whole[often[where] > 1]
    cover = np.zeros(len(h) + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + WINDOW, -1)
    out["n_repeat_words"] = run_sums((np.cumsum(cover)[:-1] > 0).astype(np.int64), bounds)
    return out


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = string_bytes(batch.column("text"))
        parts = [counts(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in slices(offsets, 1 << 20)]
        stats = [pa.array(np.concatenate([p[c] for p in parts]) if parts else np.zeros(0, np.int64), pa.int64()) for c in STATS]
        keep = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + stats, keep + STATS)


def text_counts(docs: DataFrame) -> DataFrame:
    """``docs`` with ``text`` replaced by its counts; NULL is an empty text."""
    fields = [f for f in docs.schema.fields if f.name not in STATS]
    docs = docs.select([f.name for f in fields])
    added = [T.StructField(c, T.LongType()) for c in STATS]
    return docs.mapInArrow(_count_rows, T.StructType([f for f in fields if f.name != "text"] + added))


def _features(stats: DataFrame) -> DataFrame:
    """Roughly normal columns: sizes by logarithm, shares by square root."""
    def share(part, whole):
        return F.sqrt(F.col(part) / F.greatest(F.col(whole), F.lit(1)))

    return stats.withColumns({
        "x0": F.log1p("n_words"),
        "x1": F.log(F.greatest(F.col("word_chars"), F.lit(1)) / F.greatest(F.col("n_words"), F.lit(1))),
        "x2": share("n_symbols", "word_chars"),
        "x3": share("n_dup_lines", "n_lines"),
        "x4": share("n_repeat_words", "n_words"),
    })


def _chi_square(deviations: float, p: int) -> float:
    """The chi-square value that is as rare as so many normal deviations."""
    return p * (1 - 2 / (9 * p) + deviations * np.sqrt(2 / (9 * p))) ** 3


def _solve(share: float):
    """Means and inverse covariances from sums over the central rows."""
    p = len(FEATURES)
    # Keeps the covariance of a central share consistent with the whole, for normal data.
    limit = _chi_square(_normal(share), p)
    inside = _chi_share(limit, p + 2)
    factor = share / max(inside, 1e-6)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            means, inverses = [], []
            for r in pdf.itertuples():
                s = np.array([getattr(r, f"s{i}") for i in range(p)])
                q = np.array([[getattr(r, f"q{min(i, j)}{max(i, j)}") for j in range(p)] for i in range(p)])
                mean = s / r.n
                cov = (q / r.n - np.outer(mean, mean)) * factor
                floor = np.array(LEAST_SPREAD) ** 2
                cov += np.diag(np.maximum(floor - np.diag(cov), 0) + 0.02 * floor)
                means.append(mean.tolist())
                inverses.append(np.linalg.inv(cov).ravel().tolist())
            yield pd.DataFrame({"gid": pdf["gid"], "mean": means, "inverse": inverses})

    return run


def _normal(share: float) -> float:
    from statistics import NormalDist

    return NormalDist().inv_cdf(share)


def _chi_share(x: float, p: int) -> float:
    from statistics import NormalDist

    return NormalDist().cdf(((x / p) ** (1 / 3) - 1 + 2 / (9 * p)) / np.sqrt(2 / (9 * p)))


def _distance() -> str:
    p = len(FEATURES)
    terms = [f"inverse[{i * p + j}] * (x{i} - mean[{i}]) * (x{j} - mean[{j}])" for i in range(p) for j in range(p)]
    return " + ".join(terms)


def estimates(rows: DataFrame) -> DataFrame:
    """``(gid, mean, inverse)`` per group of ``rows(gid, x0 .. x4)``."""
    p = len(FEATURES)
    sums = [F.count("*").alias("n")] + [F.sum(f"x{i}").alias(f"s{i}") for i in range(p)] + [
        F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"q{i}{j}") for i in range(p) for j in range(i, p)
    ]
    kind = "gid string, mean array<double>, inverse array<double>"
    # Start from medians and median deviations.
    half = rows.groupBy("gid").agg(*[F.percentile_approx(f"x{i}", 0.5, 2000).alias(f"m{i}") for i in range(p)])
    # One row per group, written, so that the optimizer can see whether it is small enough to be sent to the big side.
    spread = rows.join(stored(half, "medians"), "gid").groupBy("gid").agg(
        *[F.first(f"m{i}").alias(f"m{i}") for i in range(p)],
        *[(1.4826 * F.percentile_approx(F.abs(F.col(f"x{i}") - F.col(f"m{i}")), 0.5, 2000)).alias(f"d{i}") for i in range(p)],
    )
    floors = [F.greatest(F.col(f"d{i}"), F.lit(LEAST_SPREAD[i])) for i in range(p)]
    now = spread.select(
        "gid", F.array(*[F.col(f"m{i}") for i in range(p)]).alias("mean"),
        F.array(*[1 / (floors[i] * floors[i]) if i == j else F.lit(0.0) for i in range(p) for j in range(p)]).alias("inverse"),
    )
    now = stored(now, "mcd")
    for _ in range(STEPS):
        far = rows.join(now, "gid").select("gid", *FEATURES, F.expr(_distance()).alias("far"))
        limit = far.groupBy("gid").agg(F.percentile_approx("far", CORE, 2000).alias("core"))
        central = far.join(stored(limit, "core"), "gid").where("far <= core")
        now = stored(central.groupBy("gid").agg(*sums).mapInPandas(_solve(CORE), kind), "mcd")
    return now


def quality(docs: DataFrame) -> DataFrame:
    """Counts, ``base_failed``, ``kept`` and ``distance`` (squared Mahalanobis
    distance, NULL without an estimate) for ``docs(doc_id, text, lang, source)``.

    NULL, empty and wordless texts fail the base rules.  NULL languages and
    sources are groups of their own.  Groups of fewer than ``LEAST_GROUP``
    documents are pooled per language; pools that stay smaller keep all that
    pass the base rules.  Repeated rows are rows of their own.
    """
    key = F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")), F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))
    rows = docs.select("doc_id", "text", F.to_json(F.array(*key)).alias("own"), F.to_json(F.array(key[0])).alias("pool"))
    rows = _features(text_counts(rows)).withColumn(
        "base_failed", F.expr("n_words < 20 OR 100 * n_repeat_words > 30 * n_words")
    )
    rows = stored(rows, "counts")
    good = rows.where("NOT base_failed")
    sizes = good.groupBy("own", "pool").agg(F.count("*").alias("n"))
    large = sizes.where(F.col("n") >= LEAST_GROUP).select("own", F.col("own").alias("gid"))
    pools = sizes.where(F.col("n") < LEAST_GROUP).groupBy("pool").agg(F.sum("n").alias("n"))
    pools = pools.where(F.col("n") >= LEAST_GROUP).select("pool", F.col("pool").alias("pool_gid"))
    groups = stored(
        sizes.join(large, "own", "left").join(pools, "pool", "left").select("own", F.coalesce("gid", "pool_gid").alias("gid")),
        "groups",
    )
    grouped = good.join(groups.where("gid IS NOT NULL"), "own").select("gid", *FEATURES)
    found = estimates(grouped)
    judged = rows.join(groups.join(found, "gid"), "own", "left").withColumn("distance", F.expr(_distance()))
    limit = float(_chi_square(_normal(CONFIDENCE), len(FEATURES)))
    return judged.select(
        "doc_id", *STATS[:5], "base_failed",
        (~F.col("base_failed") & F.coalesce(F.col("distance") <= limit, F.lit(True))).alias("kept"), "distance",
    )
