"""Near-duplicate vectors by an inverted multi-index.

Both halves of the unit vectors have their own codebook; the pairs of
codewords are the cells of a product grid.  A vector is stored in its own
cell and looks for partners in the cells nearest to it, taken in the order of
the summed squared half distances by a multi-sequence walk, as far out as a
measured recall asks.  Pairs that meet in a cell are verified exactly.

Equal vectors are one class from the start.  Cells with many classes are cut
into blocks, and a visitor is sent to each block.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Shipped, stored, unit_hash
from .components import components

THRESHOLD = 0.95
# Rows, a hash sample, that the codebooks are fitted on, and rows that recall is measured with.
FIT_ROWS = 8_192
TUNE_ROWS = 4_096
TARGET_RECALL = 0.9999
# Vectors to a cell, on average, and most codewords of one half.
PER_CELL = 24
MOST_CODES = 1_024
# Classes of a cell compared in one task.
BLOCK = 1_024


def _halves(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cut = unit.shape[1] // 2
    return unit[:, :cut], unit[:, cut:]


def _squared(x: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (codes * codes).sum(1) - 2 * x @ codes.T, 0)


def _codebook(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Lloyd's iterations from distinct rows."""
    distinct = np.unique(x, axis=0)
    pick = np.random.default_rng(seed).permutation(len(distinct))[:k]
    codes = distinct[pick]
    for _ in range(8):
        near = _squared(x, codes).argmin(1)
        size = np.bincount(near, minlength=len(codes))
        total = np.zeros_like(codes)
        np.add.at(total, near, x)
        codes = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], codes)
    return codes


def walk(d1: np.ndarray, d2: np.ndarray, reach: float) -> list[tuple[int, int]]:
    """Multi-sequence walk: cells (i, j) by ascending d1[i] + d2[j], the
    nearest one and on until the sum passes ``reach``."""
    a, b = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
    s1, s2 = d1[a], d2[b]
    heap, out = [(s1[0] + s2[0], 0, 0)], []
    while heap:
        total, i, j = heapq.heappop(heap)
        if out and total > reach:
            break
        out.append((int(a[i]), int(b[j])))
        if j + 1 < len(s2):
            heapq.heappush(heap, (s1[i] + s2[j + 1], i, j + 1))
        # Column 0 opens the next row, so every cell is pushed once.
        if j == 0 and i + 1 < len(s1):
            heapq.heappush(heap, (s1[i + 1] + s2[0], i + 1, 0))
    return out


class Grid:
    """Codebooks of both halves, and how far beyond its own cell's distance a vector looks."""

    def __init__(self, first: np.ndarray, second: np.ndarray, slack: float):
        self.first, self.second, self.slack = first, second, slack

    def distances(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x, y = _halves(unit)
        return _squared(x, self.first), _squared(y, self.second)


def fit(sample: np.ndarray, tune: np.ndarray, rows: int, threshold: float) -> Grid:
    """Codebooks from ``sample``; the reach from pairs of ``tune`` at or above
    the threshold and from copies moved to just the threshold."""
    k = int(np.clip(np.sqrt(rows / PER_CELL), 1, MOST_CODES))
    grid = Grid(_codebook(_halves(sample)[0], k, 1), _codebook(_halves(sample)[1], k, 2), 0.0)
    if not len(tune):
        return grid
    rng = np.random.default_rng(3)
    # Partners at the very threshold, in random directions, stand for the hardest links.
    noise = rng.standard_normal(tune.shape)
    noise -= (noise * tune).sum(1)[:, None] * tune
    noise /= np.maximum(np.linalg.norm(noise, axis=1), 1e-12)[:, None]
    moved = threshold * tune + np.sqrt(1 - threshold**2) * noise
    d1, d2 = grid.distances(tune)
    e1, e2 = grid.distances(moved)
    rows_ = np.arange(len(tune))
    far = d1[rows_, e1.argmin(1)] + d2[rows_, e2.argmin(1)] - d1.min(1) - d2.min(1)
    back = e1[rows_, d1.argmin(1)] + e2[rows_, d2.argmin(1)] - e1.min(1) - e2.min(1)
    # One of the two directions is enough to meet.
    grid.slack = float(np.quantile(np.minimum(far, back), TARGET_RECALL)) + 1e-9
    return grid


# Vector lengths with a grid of their own, the most frequent ones.
GRIDS = 64


def _unit_rows(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """(which rows are usable, their vectors in double precision)."""
    lists = column.to_pylist()
    ok = np.array([v is not None and len(v) > 0 and all(x is not None for x in v) for v in lists], bool)
    return ok, [np.asarray(v, float) for v, good in zip(lists, ok) if good]


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id, direction and its bytes; NULL where nothing can link."""
    for batch in batches:
        ok, vectors = _unit_rows(batch.column("embedding"))
        keys: list[bytes | None] = [None] * batch.num_rows
        units: list[bytes | None] = [None] * batch.num_rows
        dims = [0] * batch.num_rows
        for i, v in zip(np.flatnonzero(ok), vectors):
            top = np.abs(v).max()
            if not np.isfinite(v).all() or top == 0:
                continue
            norm = np.linalg.norm(v / top)
            keys[i], units[i], dims[i] = (v + 0.0).astype("<f8").tobytes(), (v / top / norm).astype("<f8").tobytes(), len(v)
        yield pa.RecordBatch.from_arrays(
            [batch.column("vec_id"), pa.array(keys, pa.binary()), pa.array(units, pa.binary()), pa.array(dims, pa.int32())],
            ["vec_id", "key", "unit", "dim"],
        )


def _matrix(column) -> np.ndarray:
    values = [np.frombuffer(x, "<f8") for x in column]
    return np.stack(values) if values else np.zeros((0, 1))


def _place(shipped: Shipped):
    """Every class in its own cell (visit 0), and as a visitor of the near ones (1)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grids = shipped.get()
        for batch in batches:
            ids, dims = batch.column("node").to_numpy(), batch.column("dim").to_numpy()
            out = []
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                grid = grids.get(int(dim))
                if grid is None:
                    # A rare length has one cell, whose blocks are compared all with all.
                    out += [(x, dim, 0, 0) for x in ids[rows].tolist()]
                    continue
                unit = _matrix(batch.column("unit").take(pa.array(rows)).to_pylist())
                d1, d2 = grid.distances(unit)
                own = d1.argmin(1) * np.int64(len(grid.second)) + d2.argmin(1)
                reach = d1.min(1) + d2.min(1) + grid.slack
                for r in range(len(rows)):
                    cells = [i * len(grid.second) + j for i, j in walk(d1[r], d2[r], reach[r])]
                    out.append((ids[rows[r]], dim, own[r], 0))
                    out += [(ids[rows[r]], dim, c, 1) for c in cells if c != own[r]]
            node, dim, cell, visit = zip(*out) if out else ((),) * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(node, pa.int64()), pa.array(dim, pa.int32()), pa.array(cell, pa.int64()), pa.array(visit, pa.int32())],
                ["node", "dim", "cell", "visit"],
            )

    return run


def _verify(threshold: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Pairs of a block's own classes with each other and with its visitors."""
        own, seen = pdf[pdf["visit"] == 0], pdf
        if not len(own):
            return pd.DataFrame({"a": [], "b": []}, dtype=np.int64)
        a, b = _matrix(own["unit"]), _matrix(seen["unit"])
        ia, ib = own["node"].to_numpy(), seen["node"].to_numpy()
        out = []
        for at in range(0, len(b), 2048):
            i, j = np.nonzero(a @ b[at : at + 2048].T >= threshold - 1e-9)
            out.append(np.stack((ia[i], ib[at + j]), 1))
        pairs = np.concatenate(out)
        pairs = np.unique(np.sort(pairs[pairs[:, 0] != pairs[:, 1]], axis=1), axis=0)
        if len(pairs):
            # Once more in a plain sum of products, so that a pair's verdict does not hang on its block.
            where = {n: k for k, n in enumerate(ib)}
            u, v = b[[where[x] for x in pairs[:, 0]]], b[[where[x] for x in pairs[:, 1]]]
            cosine = (u * v).sum(1) / np.sqrt((u * u).sum(1) * (v * v).sum(1))
            pairs = pairs[cosine >= threshold]
        return pd.DataFrame(pairs, columns=["a", "b"])

    return run


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for ``vectors(vec_id, embedding)``.

    Rows link when their cosine is ``threshold`` or more.  Vectors that are
    NULL, empty, zero or hold NULL or non-finite components link with nothing;
    vectors of different lengths never link.  Copies count as links of each
    other.  ``kept`` is the row with the component's smallest vec_id.  Rows of
    one vec_id with different vectors are different vectors; a NULL vec_id is
    no smallest one, and where a component has no other, its id is NULL.
    """
    spark = vectors.sparkSession
    rows = stored(
        vectors.select("vec_id", "embedding").mapInArrow(_classes, "vec_id long, key binary, unit binary, dim int")
        .withColumn("hash", F.sha2("key", 256)), "vectors",
    )
    usable = rows.where("key IS NOT NULL")
    # One row per distinct vector, with a number of its own for as long as it is written; ids may be NULL or shared.
    nodes = usable.groupBy("hash").agg(
        F.min("vec_id").alias("lowest"), F.count("*").alias("copies"), F.first("unit").alias("unit"), F.first("dim").alias("dim")
    )
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()), "classes")
    lengths = nodes.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim")
    sizes = {r["dim"]: r["n"] for r in lengths.limit(GRIDS).collect()}
    grids = {}
    for dim, n in sizes.items():
        # Bounded samples: FIT_ROWS and TUNE_ROWS rows on average, whatever the table's size.
        part = nodes.where(F.col("dim") == dim).withColumn("u", unit_hash("hash", salt="index"))
        picked = part.where(F.col("u") < min(1.0, (FIT_ROWS + TUNE_ROWS) / n)).select("unit", "u").orderBy("u")
        sample = _matrix([bytes(r["unit"]) for r in picked.limit(2 * (FIT_ROWS + TUNE_ROWS)).collect()])
        cut = len(sample) * FIT_ROWS // (FIT_ROWS + TUNE_ROWS) if len(sample) > 64 else len(sample)
        grids[int(dim)] = fit(sample[: max(cut, 1)], sample[cut:] if len(sample) > 64 else sample, n, threshold)
    shipped = Shipped(spark, grids)
    places = stored(nodes.select("node", "unit", "dim").mapInArrow(_place(shipped), "node long, dim int, cell long, visit int"), "places")
    full = places.where("visit = 0").groupBy("dim", "cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    # An own class is in one block of its cell; to compare blocks with each other, it also visits the others.
    placed = places.join(full, ["dim", "cell"]).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    placed = placed.select("node", "dim", "cell", "visit", "own", F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"))
    placed = placed.where("visit = 1 OR block <= own").select(
        "node", "dim", "cell", "block", F.expr("IF(visit = 0 AND block = own, 0, 1)").alias("visit")
    )
    pairs = placed.join(nodes.select("node", "unit"), "node").groupBy("dim", "cell", "block").applyInPandas(
        _verify(threshold), "a long, b long"
    )
    links = stored(pairs.distinct(), "links")

    label = components(links)
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = both.join(nodes.select(F.col("node").alias("b"), "copies"), "b").groupBy(F.col("a").alias("node")).agg(
        F.sum("copies").alias("partners")
    )
    classes = nodes.select("hash", "node", "copies", "lowest").join(label, "node", "left").join(degree, "node", "left").select(
        "hash", "lowest", (F.coalesce("partners", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component")
    )
    classes = stored(classes, "judged")
    # A component is named by its smallest id, combined before the shuffle.
    names = classes.groupBy("component").agg(F.min("lowest").alias("component_id"))
    classes = classes.join(names, "component").select("hash", "n_links", "component_id", F.lit(True).alias("usable"))
    out = rows.select("vec_id", "hash").join(classes, "hash", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("usable"), F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id"),
    )
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
