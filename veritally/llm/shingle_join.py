"""N-gram Jaccard join by parity sketches.

A document is its set of distinct 5-word shingles.  The set's hash range is
cut into ``P`` equal segments and the hashes in each are XORed: a parity
sketch.  Sets that differ in ``d`` shingles differ in at most ``d`` segments,
so sets of enough similarity agree in at least ``P - d`` of them (pigeonhole)
and meet in a join on (size band, segment, value).  What meets is checked
with one-bit parity sketches, whose Hamming distance is a lower bound of the
symmetric difference, and then exactly.

Nothing is lost to skew:

* Equal sets are one node from the start, however many documents share them.
* A set must agree with a partner in at least ``c`` non-empty segments, so it
  may leave out its ``c - 1`` most common values: ordered by (count, value),
  both partners keep the rarest value that they share.
* Values that stay common are linked to one pivot first; only sets that are
  then still in different components are compared further, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import mix64, narrow_batches, ragged, release, slices, stored, string_bytes
from .components import components
from .text import shingles, words

# Similarity as a fraction, NUM / DEN.
NUM, DEN = 75, 100
# A value with more sets than this is common.
COMMON = 32
# Signatures a task holds before it packs them, and bytes of them per reduce partition.
PACK_ROWS = 1 << 19
# Pivots of a common value that all its sets are compared with, after the first.
PIVOTS = 2
# Rows of a common value compared with each other in one task.
BLOCK = 2_000


def _bands(limit: int = 1 << 40) -> np.ndarray:
    """First sizes of the bands: each reaches to 4/3 of its first size."""
    out = [1]
    while out[-1] < limit:
        out.append(max(out[-1] + 1, (out[-1] * DEN) // NUM))
    return np.array(out, np.int64)


BANDS = _bands()


def most_different(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Largest symmetric difference of linked sets of sizes n and m."""
    return ((n + m) * (DEN - NUM)) // (DEN + NUM)


def segments(first: int, last: int) -> int:
    """Segments for a band whose larger sets have ``first`` to ``last`` elements:
    enough that the agreeing segments outnumber the empty ones."""
    d = int(most_different(np.int64(last), np.int64(last)))
    if d == 0:
        return 1
    best = d + 1
    while best < 4 * last + 8:
        worst = min(
            best - int(most_different(np.int64(a), np.int64(b))) - best * np.exp(-a / best)
            - 2 * np.sqrt(best * np.exp(-a / best) * (1 - np.exp(-a / best)))
            for a, b in ((first, first), (first, last), (last, last), (max(1, first * NUM // DEN), first))
        )
        if worst >= 1:
            break
        best += max(1, best // 32)
    return best


_SEGMENTS: dict[int, int] = {}


def _segments(band: int) -> int:
    if band not in _SEGMENTS:
        _SEGMENTS[band] = segments(int(BANDS[band]), int(BANDS[band + 1]) - 1)
    return _SEGMENTS[band]


def signatures(s: np.ndarray, band: int) -> tuple[np.ndarray, int]:
    """Values of the sorted set ``s`` in a band's scheme, and how many agreeing
    non-empty values a partner is sure to have (1 at least).

    A set with too many empty segments for that guarantee also gets a value
    for each empty one, which only other such sets have.
    """
    n, p = len(s), _segments(band)
    seg = ((s >> np.uint64(32)) * np.uint64(p)) >> np.uint64(32)
    first = np.flatnonzero(np.diff(seg, prepend=np.uint64(p)) != 0)
    seg = seg[first]
    salt = np.uint64(band) << np.uint64(40)
    value = mix64(np.bitwise_xor.reduceat(s, first) + mix64(seg | salt))
    partner = min(n * DEN // NUM, int(BANDS[band + 1]) - 1)
    sure = p - int(most_different(np.int64(n), np.int64(partner))) - (p - len(seg))
    if sure >= 1:
        return value, sure
    empty = np.setdiff1d(np.arange(p, dtype=np.uint64), seg)
    return np.concatenate((value, mix64(mix64(empty | salt) ^ np.uint64(0xE5)))), 1


def bit_sketch(s: np.ndarray) -> np.ndarray:
    """Parities of ``2^k`` (about 2 to 4 per element) equal hash ranges, packed.

    Adding neighbouring bits modulo 2 gives the sketch of half the length.
    """
    k = max(6, int(2 * len(s) - 1).bit_length())
    bits = np.bincount((s >> np.uint64(64 - k)).astype(np.int64), minlength=1 << k) & 1
    return np.packbits(bits.astype(np.uint8))


def _fold(sketch: np.ndarray, size: int) -> np.ndarray:
    bits = np.unpackbits(sketch)
    while len(bits) > size:
        bits = bits[0::2] ^ bits[1::2]
    return bits


def hamming(a: bytes, b: bytes) -> int:
    a, b = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(a) != len(b):
        size = 8 * min(len(a), len(b))
        return int((_fold(a, size) ^ _fold(b, size)).sum())
    return int(np.bitwise_count(a ^ b).sum())


def linked(common: int, n: int, m: int) -> bool:
    return DEN * common >= NUM * (n + m - common)


def _sets(batch: pa.RecordBatch):
    """(row, sorted distinct shingle hashes) for every row of a batch."""
    data, offsets = string_bytes(batch.column("text"))
    for a, b in slices(offsets, 1 << 20):
        hashes, _, bounds = words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        grams, at = shingles(hashes, bounds)
        for d in range(b - a):
            yield a + d, np.unique(grams[at[d] : at[d + 1]])


def _node(s: np.ndarray) -> int:
    """A set's identity: 63 bits over all its elements."""
    if not len(s):
        return -1
    h = mix64(np.array([int(np.bitwise_xor.reduce(mix64(s + np.uint64(5)))), int(s.sum(dtype=np.uint64))], np.uint64))
    return int(mix64(h[:1] ^ (h[1:] + np.uint64(len(s))))[0] >> np.uint64(1))


# kind 0: a document and its set's size, 1: packed signatures, 2: members of a value common within one task.
_OUT = pa.schema([
    ("kind", pa.int8()), ("bucket", pa.int64()), ("doc_id", pa.int64()), ("node", pa.int64()), ("n", pa.int64()),
    ("sketch", pa.binary()), ("keys", pa.binary()), ("nodes", pa.binary()), ("sure", pa.binary()),
])


def _rows(**columns) -> pa.RecordBatch:
    size = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in _OUT], schema=_OUT
    )


def _sign(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        seen: set[int] = set()
        keys, nodes, sure, held = [], [], [], 0

        def packed():
            """Signatures by bucket; of a value's sets beyond the first COMMON + 1
            only memberships remain, spread over all buckets."""
            k, v, c = np.concatenate(keys), np.concatenate(nodes), np.concatenate(sure)
            keys.clear(), nodes.clear(), sure.clear()
            order = np.argsort(k, kind="stable")
            k, v, c = k[order], v[order], c[order]
            first = np.flatnonzero(np.diff(k, prepend=~k[:1]) != 0)
            rank = np.arange(len(k)) - np.repeat(first, np.diff(first, append=len(k)))
            over = rank > COMMON
            for kind, rows in ((1, np.flatnonzero(~over)), (2, np.flatnonzero(over))):
                if not len(rows):
                    continue
                if kind == 1:
                    bucket = ((k[rows] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
                    cut = np.flatnonzero(np.diff(bucket, prepend=-1))
                    to = bucket[cut]
                else:
                    cut = np.arange(0, len(rows), 1 << 14)
                    to = (v[rows[cut]] + cut) % buckets
                parts = np.split(rows, cut[1:])
                yield _rows(
                    kind=[kind] * len(parts), bucket=to, keys=[k[p].tobytes() for p in parts],
                    nodes=[v[p].tobytes() for p in parts], sure=[c[p].tobytes() for p in parts],
                )

        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            docs = []
            for row, s in _sets(batch):
                node = _node(s)
                fresh = len(s) and node not in seen
                docs.append((ids[row], node, len(s), bit_sketch(s).tobytes() if fresh else None))
                if not fresh:
                    continue
                if len(seen) >= 1 << 20:
                    seen.clear()
                seen.add(node)
                band = int(np.searchsorted(BANDS, len(s), "right")) - 1
                for b in (band, band + 1):
                    if b > band and len(s) * DEN < NUM * BANDS[b]:
                        continue
                    value, least = signatures(s, b)
                    keys.append(value)
                    nodes.append(np.full(len(value), node, np.int64))
                    sure.append(np.full(len(value), min(least, 65535), np.uint16))
                    held += len(value)
                if held >= PACK_ROWS:
                    yield from packed()
                    held = 0
            if docs:
                doc, node, n, sketch = zip(*docs)
                yield _rows(kind=[0] * len(docs), bucket=np.array(node) % buckets, doc_id=doc, node=node, n=n, sketch=sketch)
        if held:
            yield from packed()

    return run


# kind 0 as above, 3: two sets that share a rare value, 4: a set that has a common value.
_MET = pa.schema([
    ("kind", pa.int8()), ("doc_id", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("sketch", pa.binary()),
    ("other", pa.int64()), ("sure", pa.int32()),
])


def _met(**columns) -> pa.RecordBatch:
    size = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in _MET], schema=_MET
    )


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release()
    keys, nodes, sure = [], [], []
    for batch in batches:
        kind = batch.column("kind").to_numpy()
        docs = batch.filter(pa.array(kind == 0))
        if docs.num_rows:
            yield _met(**{c: docs.column(c) for c in ("kind", "doc_id", "node", "n", "sketch")})
        for row in batch.filter(pa.array(kind > 0)).select(["kind", "keys", "nodes", "sure"]).to_pylist():
            k, v, c = np.frombuffer(row["keys"], np.uint64), np.frombuffer(row["nodes"], np.int64), np.frombuffer(row["sure"], np.uint16)
            if row["kind"] == 1:
                keys.append(k), nodes.append(v), sure.append(c)
            else:
                yield _met(kind=np.full(len(k), 4, np.int8), node=v, other=k.view(np.int64), sure=c.astype(np.int32))
    if not keys:
        return
    k, v, c = np.concatenate(keys), np.concatenate(nodes), np.concatenate(sure)
    del keys, nodes, sure
    order = np.argsort(k, kind="stable")
    k = k[order]
    again = np.zeros(len(k), bool)
    again[1:] = k[1:] == k[:-1]
    shared = again.copy()
    shared[:-1] |= again[1:]
    order = order[shared]
    k, v, c = k[shared], v[order], c[order]
    order = np.lexsort((v, k))
    k, v, c = k[order], v[order], c[order]
    fresh = np.ones(len(k), bool)
    fresh[1:] = (k[1:] != k[:-1]) | (v[1:] != v[:-1])
    k, v, c = k[fresh], v[fresh], c[fresh]
    first = np.flatnonzero(np.diff(k, prepend=~k[:1] if len(k) else None) != 0) if len(k) else np.zeros(0, np.int64)
    size = np.diff(first, append=len(k))
    many = np.flatnonzero(size > COMMON)
    if len(many):
        at = ragged(first[many], size[many])
        yield _met(kind=np.full(len(at), 4, np.int8), node=v[at], other=k[at].view(np.int64), sure=c[at].astype(np.int32))
    pairs = []
    for step in range(1, COMMON):
        groups = np.flatnonzero((size > step) & (size <= COMMON))
        if not len(groups):
            break
        left = ragged(first[groups], size[groups] - step)
        pairs.append(np.unique(np.stack((v[left], v[left + step]), 1), axis=0) if len(left) < 1 << 20 else np.stack((v[left], v[left + step]), 1))
    if pairs:
        found = np.unique(np.concatenate(pairs).view([("a", np.int64), ("b", np.int64)]).ravel())
        for at in range(0, len(found), 1 << 17):
            part = found[at : at + (1 << 17)]
            yield _met(kind=np.full(len(part), 3, np.int8), node=part["a"], other=part["b"])


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose sizes and sketches allow a link."""
    for batch in batches:
        n, m = batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()
        low, high = np.minimum(n, m), np.maximum(n, m)
        may = most_different(n, m)
        ok = low * DEN >= NUM * high
        a, b = batch.column("sketch_a"), batch.column("sketch_b")
        for i in np.flatnonzero(ok):
            ok[i] = hamming(a[i].as_py(), b[i].as_py()) <= may[i]
        yield batch.filter(pa.array(ok)).select(["a", "b"])


def _close(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs(a, b)`` that sizes and sketches do not rule out."""
    def side(x):
        return sets.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}"))

    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(_near, "a long, b long")


def _texts_to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every text's own node and set, equal ones of a task about once."""
    seen: set[int] = set()
    for batch in batches:
        nodes, packed = [], []
        for _, s in _sets(batch):
            node = _node(s)
            if node in seen:
                continue
            if len(seen) >= 1 << 20:
                seen.clear()
            seen.add(node)
            nodes.append(node), packed.append(s.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(packed, pa.binary())], ["node", "elements"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = batch.column("elements_a"), batch.column("elements_b")
        ok = np.zeros(batch.num_rows, bool)
        for i in range(batch.num_rows):
            x, y = np.frombuffer(a[i].as_buffer(), np.uint64), np.frombuffer(b[i].as_buffer(), np.uint64)
            both = np.concatenate((x, y))
            both.sort(kind="stable")
            ok[i] = linked(int((both[1:] == both[:-1]).sum()), len(x), len(y))
        yield batch.filter(pa.array(ok)).select(["a", "b"])


def _exact(pairs: DataFrame, sets: DataFrame, documents: DataFrame) -> DataFrame:
    """Links among ``pairs``, from the texts of one document per set."""
    asked = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    ids = asked.join(sets.select("node", "doc_id"), "node")
    # The node is told from the text: a doc_id may have several texts, and a set may be that of texts without an id only.
    texts = documents.select("doc_id", "text").join(ids.select("doc_id"), "doc_id", "left_semi").select("text")
    texts = texts.union(documents.where("doc_id IS NULL").select("text"))
    full = texts.mapInArrow(_texts_to_sets, "node long, elements binary").join(asked, "node", "left_semi")
    full = stored(full.dropDuplicates(["node"]), "sets")
    left = full.select(F.col("node").alias("a"), F.col("elements").alias("elements_a"))
    right = full.select(F.col("node").alias("b"), F.col("elements").alias("elements_b"))
    return pairs.join(left, "a").join(right, "b").mapInArrow(_verify, "a long, b long")


def _compare_blocks(pdf: pd.DataFrame) -> pd.DataFrame:
    """Pairs across components in one block of a common value's sets.

    A pair is made by the smallest of the values that both sets kept, and by
    no other, so it is made once however many values they share.
    """
    value = pdf["value"].iloc[0]
    one, two = pdf[pdf["side"] < 2], pdf[pdf["side"] != 1]
    out = []
    sketches = [np.frombuffer(x, np.uint8) for x in two["sketch"]]
    length = np.array([len(x) for x in sketches])
    mats = {n: np.stack([sketches[i] for i in np.flatnonzero(length == n)]) for n in np.unique(length)}
    where = {n: np.flatnonzero(length == n) for n in mats}
    n2, c2, v2, kept = two["n"].to_numpy(), two["component"].to_numpy(), two["node"].to_numpy(), two["kept"].tolist()
    for r in one.itertuples():
        mine = np.frombuffer(r.sketch, np.uint8)
        may = most_different(np.int64(r.n), n2)
        ok = (c2 != r.component) & (v2 != r.node) & (np.minimum(n2, r.n) * DEN >= NUM * np.maximum(n2, r.n))
        for size, rows in where.items():
            rows = np.flatnonzero(ok[rows])
            if not len(rows):
                continue
            at = where[size][rows]
            if size == len(mine):
                ok[at] = np.bitwise_count(mats[size][rows] ^ mine).sum(1) <= may[at]
            else:
                ok[at] = [hamming(r.sketch, sketches[i].tobytes()) <= may[i] for i in at]
        mine = set(r.kept)
        at = np.array([i for i in np.flatnonzero(ok) if next(x for x in kept[i] if x in mine) == value], np.int64)
        out.append(np.stack((np.minimum(v2[at], r.node), np.maximum(v2[at], r.node)), 1))
    found = np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), np.int64)
    return pd.DataFrame(found, columns=["a", "b"])


def _labelled(stay: DataFrame, label: DataFrame) -> DataFrame:
    return stay.join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _next_pivots(stay: DataFrame, label: DataFrame) -> DataFrame:
    """Pairs of sets with a new pivot of their common value, across components.

    Only values with components of some size take part: comparing a value's
    unrelated single sets is left to the blocks.
    """
    rows = _labelled(stay, label)
    groups = rows.groupBy("value", "component").agg(
        F.count("*").alias("sets"), F.max(F.struct("values", (-F.col("node")).alias("order"))).alias("best")
    )
    # The component with most sets is done: its pivot has been compared with all.
    top = groups.groupBy("value").agg(F.max(F.struct("sets", "component"))["component"].alias("largest"), F.count("*").alias("k"))
    rest = groups.join(top.where("k > 1"), "value").where("component <> largest")
    pivot = rest.groupBy("value").agg(F.max("best").alias("best"), F.max(F.struct("best", "component"))["component"].alias("own"))
    pivot = pivot.select("value", "own", (-F.col("best.order")).alias("next"))
    pairs = rows.select("node", "value", "component").join(pivot, "value").where("component <> own")
    return pairs.select(F.least("node", "next").alias("a"), F.greatest("node", "next").alias("b")).distinct()


def similarity_links(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents' sets ``(doc_id, node, n)``, links ``(a, b)`` between nodes).

    A node stands for all documents with an equal set; -1 for an empty one.
    """
    spark = documents.sparkSession
    narrow_batches(spark)
    buckets = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = documents.select("doc_id", "text").mapInArrow(_sign(buckets), _ddl(_OUT))
    met = stored(rows.repartition(buckets, "bucket").mapInArrow(_meet, _ddl(_MET)), "met")
    docs = met.where("kind = 0").select("doc_id", "node", "n")
    sets = (
        met.where("kind = 0 AND node >= 0").groupBy("node")
        .agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.max("sketch").alias("sketch"))
    )
    sets = stored(sets, "nodes")
    rare = met.where("kind = 3").select(F.col("node").alias("a"), F.col("other").alias("b")).distinct()

    common = met.where("kind = 4").select("node", F.col("other").alias("value"), "sure").distinct()
    # The pivot is the set with most common values: the one that copies were made from, if it is there.
    central = common.groupBy("node").agg(F.count("*").alias("values"))
    common = stored(common.join(central, "node"), "members")
    best = F.struct("values", (-F.col("node")).alias("order"))
    sizes = common.groupBy("value").agg(F.count("*").alias("sets"), (-F.max(best)["order"]).alias("pivot"))
    ranked = common.join(sizes, "value").groupBy("node", "sure", "values").agg(
        F.sort_array(F.collect_list(F.struct("sets", "value", "pivot")), False).alias("most")
    )
    # A set leaves out its most common values, one fewer than it must share.  The list is bounded by the set's own segments.
    stay = stored(
        ranked.select("node", "values", F.explode(F.expr("slice(most, sure, greatest(size(most) - sure + 1, 0))")).alias("v"))
        .select("node", "values", "v.value", "v.pivot"), "common",
    )
    stars = stay.where("node <> pivot").select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()
    pairs = stored(_close(rare.union(stars).distinct(), sets), "pairs")
    links = stored(_exact(pairs, sets, documents), "links")

    # Further pivots, each the most central set outside the components of the earlier ones.
    label = components(links)
    for _ in range(PIVOTS):
        more = _next_pivots(stay, label).join(pairs, ["a", "b"], "left_anti")
        more = stored(_close(more, sets), "pairs")
        if not more.limit(1).count():
            break
        pairs = pairs.union(more)
        links = links.union(stored(_exact(more, sets, documents), "links"))
        label = components(links)

    # Sets that share a common value and are still apart.
    apart = _labelled(stay, label).select("node", "value", "component")
    split = apart.groupBy("value").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("size")).where("x <> y")
    split = split.select("value", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    # At most as many values as the set has segments.
    kept = stay.groupBy("node").agg(F.sort_array(F.collect_set("value")).alias("kept"))
    members = apart.join(split, "value").join(sets.select("node", "n", "sketch"), "node").join(kept, "node")
    members = members.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # Every pair of blocks is one task's work: side 0 within a block, 1 and 2 across two.
    placed = members.select(
        "*", F.explode(F.expr("sequence(0, blocks - 1)")).alias("facing")
    ).select(
        "value", F.least("own", "facing").alias("p"), F.greatest("own", "facing").alias("q"), "node", "component", "n", "sketch", "kept",
        F.expr("CASE WHEN own = facing THEN 0 WHEN own < facing THEN 1 ELSE 2 END").alias("side"),
    )
    late = placed.groupBy("value", "p", "q").applyInPandas(_compare_blocks, "a long, b long").distinct()
    late = stored(late.join(pairs, ["a", "b"], "left_anti"), "late")
    return docs, links.union(_exact(late, sets, documents))


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int8(): "tinyint", pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def shingle_join(documents: DataFrame) -> DataFrame:
    """``(doc_id, n_shingles, component_id)``, one row per document.

    Documents link when their sets of distinct 5-word shingles have a Jaccard
    similarity of 0.75 or more; shorter texts are one shingle; NULL, empty and
    wordless texts have no shingle and link with nothing.  The component is
    the smallest doc_id reachable by links.  Rows that repeat a doc_id stay
    rows of their own, and each keeps its own set.
    """
    docs, links = similarity_links(documents)
    label = components(links)
    # One row per set, so that a set with very many documents is no hot spot.
    sets = docs.where("node >= 0").groupBy("node").agg(F.min("doc_id").alias("least"))
    sets = sets.join(label, "node", "left").select("node", "least", F.coalesce("component", "node").alias("component"))
    lowest = sets.groupBy("component").agg(F.min("least").alias("component_id"))
    named = stored(sets.join(lowest, "component").select("node", "component_id"), "named")
    return docs.join(named, "node", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")
    )
