"""Merkle manifest of a dataset as a content-addressed graph of digests.

Every row is a leaf; the leaves of one tree (a language) ascend by key, two
consecutive nodes become their digest until one is left, the subroot, and the
subroots likewise become the root.  ``SEGMENT`` levels are stored as one
record: the digest at its top, and the digests of all levels below it.  A
leaf's proof is found by descent: from the root's record the digits of its
rank choose the child, the children not chosen are collected, and the path is
turned round at the end.  Leaves with the same prefix of digits share the
descent down to there, so no record is asked for by more than the 2^SEGMENT
prefixes below it.

Odd cases: NULL in a column is ``-`` in its leaf; a NULL key sorts first and
is never altered; rows of one key are ordered by their digests, and equal rows
are leaves of their own with equal digests.  A NULL tree is a tree (the first
one).  An empty table has no leaves and no root.  Other columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import stored

# Levels of a record: 2^SEGMENT digests are at its bottom.
SEGMENT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """``-`` for NULL, else UTF-8 byte count, colon, value."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(fields=FIELDS, **replaced: Column) -> Column:
    """The digest of a row, with some of its values replaced."""
    return digest(*[field(replaced.get(c, F.col(c))) for c in fields])


def levels(bottom: Column, height: Column) -> Column:
    """``height`` + 1 arrays of digests: ``bottom`` and every level above it."""

    def above(acc: Column, _) -> Column:
        last = F.element_at(acc, -1)
        half = F.ceil(F.size(last) / 2).cast("int")
        return F.array_append(
            acc,
            F.transform(
                F.sequence(F.lit(0), half - 1),
                lambda i: digest(F.get(last, 2 * i), F.coalesce(F.get(last, 2 * i + 1), F.lit(""))),
            ),
        )

    return F.aggregate(F.sequence(F.lit(1), height), F.array(bottom), above)


def ranked(rows: DataFrame, *order: str) -> DataFrame:
    """Adds ``rank`` (from 0) within ``tree`` by ``order``, and ``n``, the tree's rows.

    Ranges of (tree, order) go to tasks; a rank is the place in the task plus
    the rows of the tree in earlier tasks, of which there is one number per
    task and tree.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    at = F.monotonically_increasing_id()
    kept = stored(
        rows.repartitionByRange(parts, "tree", *order).sortWithinPartitions("tree", *order)
        .select("*", F.shiftright(at, 33).alias("part"), at.bitwiseAND((1 << 33) - 1).alias("place")),
        "ranked",
    )
    earlier = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = stored(
        kept.groupBy("tree", "part").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("here"))
        .select(
            F.col("tree").alias("of"), F.col("part").alias("in"), "first",
            F.coalesce(F.sum("here").over(earlier), F.lit(0)).alias("before"),
            F.sum("here").over(Window.partitionBy("tree")).alias("n"),
        ),
        "starts",
    )
    return (
        kept.join(starts, kept["tree"].eqNullSafe(starts["of"]) & (kept["part"] == starts["in"]))
        .withColumn("rank", F.col("place") - F.col("first") + F.col("before"))
        .drop("part", "place", "of", "in", "first", "before")
    )


def build(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """From ``nodes(tree, n, rank, digest)`` to (roots, records of every segment, lowest first).

    ``roots(tree, digest)`` has a row per tree; a record is ``(digest,
    levels)``.  Up to 2^SEGMENT digests meet in a group.
    """
    nodes = nodes.select("tree", "n", "rank", "digest")
    most = nodes.agg(F.max("n")).first()[0] or 0
    roots, records = [nodes.where("n = 1")], []
    while most > 1:
        below = F.transform(F.array_sort(F.collect_list(F.struct("rank", "digest"))), lambda x: x["digest"])
        # As many levels as the tree still has, at most SEGMENT.
        height = F.least(F.length(F.bin(F.col("n") - 1)), F.lit(SEGMENT))
        segment = stored(
            nodes.where("n > 1").groupBy("tree", "n", F.shiftright("rank", SEGMENT).alias("rank"))
            .agg(below.alias("below"))
            .select("tree", "n", "rank", levels(F.col("below"), height).alias("levels"))
            .withColumn("digest", F.get(F.element_at("levels", -1), F.lit(0))),
            "segment",
        )
        records.append(segment.select("digest", "levels"))
        nodes = segment.select("tree", F.ceil(F.col("n") / (1 << SEGMENT)).alias("n"), "rank", "digest")
        roots.append(nodes.where("n = 1"))
        most = -(-most // (1 << SEGMENT))
    found = roots[0]
    for more in roots[1:]:
        found = found.unionByName(more)
    return found.select("tree", "digest"), records


_PATH = "array<struct<digest:string,left:boolean>>"


def descend(roots: DataFrame, records: list[DataFrame], requests: DataFrame) -> DataFrame:
    """``(tree, rank, digest, path)`` of the requested ``(tree, rank)``.

    ``roots(tree, digest, path)`` is where the descent begins; the path grows
    downwards by ``(digest, left)`` of every child not chosen, a NULL digest
    where the chosen one has no sibling.
    """
    here = roots.select(F.col("tree").alias("of"), F.lit(0).cast("long").alias("prefix"), "digest", "path")
    for depth in range(len(records) - 1, -1, -1):
        record = records[depth].dropDuplicates(["digest"]).withColumnRenamed("digest", "top")
        # A tree that ends above this segment has no record here and is passed on.
        opened = here.join(record, here["digest"] == record["top"], "left").drop("top")
        asked = requests.select("tree", F.shiftright("rank", SEGMENT * depth).alias("rank")).distinct()
        digit = F.col("rank").bitwiseAND((1 << SEGMENT) - 1).cast("int")

        def step(level: Column) -> Column:
            index = F.call_function("shiftright", digit, level)
            sibling = F.get(F.get("levels", level), index.bitwiseXOR(F.lit(1)))
            return F.struct(sibling.alias("digest"), (index.bitwiseAND(F.lit(1)) == 1).alias("left"))

        down = F.transform(F.sequence(F.size("levels") - 2, F.lit(0), F.lit(-1)), step)
        here = asked.join(
            opened, asked["tree"].eqNullSafe(opened["of"]) & (F.shiftright("rank", SEGMENT) == opened["prefix"])
        ).select(
            F.col("tree").alias("of"), F.col("rank").alias("prefix"),
            F.when(F.col("levels").isNull(), F.col("digest")).otherwise(F.get(F.get("levels", F.lit(0)), digit)).alias("digest"),
            F.when(F.col("levels").isNull(), F.col("path")).otherwise(F.concat("path", down)).alias("path"),
        )
    return here.withColumnsRenamed({"of": "tree", "prefix": "rank"})


class Manifest(NamedTuple):
    """A written manifest: leaves with their ranks, and the graph above them."""

    leaves: DataFrame  # tree, rank, digest and the columns asked for
    subroots: DataFrame  # tree, rank, digest
    records: list[DataFrame]
    top_records: list[DataFrame]
    root: str | None

    def proofs(self, requests: DataFrame) -> DataFrame:
        """``(tree, rank, digest, proof)`` of leaves given by ``(tree, rank)``.

        ``proof`` goes from the leaf to the root: ``(digest, left)`` of every
        sibling, NULL where there is none.
        """
        spark = requests.sparkSession
        top = spark.range(1).select(
            F.lit(None).cast("string").alias("tree"), F.lit(self.root).alias("digest"), F.array().cast(_PATH).alias("path")
        )
        trees = requests.select(F.col("tree").alias("of")).distinct()
        wanted = self.subroots.join(trees, F.col("tree").eqNullSafe(F.col("of")))
        above = descend(top, self.top_records, wanted.select(F.lit(None).cast("string").alias("tree"), "rank"))
        starts = wanted.select("tree", "rank").join(above.select("rank", "digest", "path"), "rank")
        found = descend(starts, self.records, requests)
        return found.select("tree", "rank", "digest", F.reverse("path").alias("proof"))


def write(rows: DataFrame, keys: list[str], tree: str, kept: list[str]) -> Manifest:
    """Writes the manifest of ``rows``, which have a ``leaf`` and the named columns.

    Only digests, keys and ``kept`` columns are shuffled, after the texts have
    been read once.
    """
    narrow = stored(rows.select(F.col(tree).alias("tree"), *keys, "leaf", *kept), "leaves")
    leaves = stored(ranked(narrow, *keys, "leaf").withColumnRenamed("leaf", "digest"), "leaves")
    roots, records = build(leaves)
    roots = roots.select(F.lit(None).cast("string").alias("tree"), F.col("tree").alias("name"), "digest")
    subroots = stored(ranked(roots, "name"), "subroots")
    top, top_records = build(subroots)
    root = top.first()
    return Manifest(
        leaves, subroots.select(F.col("name").alias("tree"), "rank", "digest"), records, top_records,
        root["digest"] if root else None,
    )


def fold(start: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(
        proof, start,
        lambda acc, s: F.when(s["digest"].isNull(), digest(acc)).when(s["left"], digest(s["digest"], acc)).otherwise(digest(acc, s["digest"])),
    )


def manifest(documents: DataFrame, every: int = 7) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` per row.

    Where ``every`` divides the crc32 of the doc_id, the leaf that is folded
    has one more in ``n_chars``, so that it must not lead to the root.
    """
    altered = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(every)) == 0
    more = F.col("n_chars").cast("decimal(20,0)") + 1
    rows = documents.select(
        "doc_id", "lang", leaf().alias("leaf"), F.when(altered & F.col("n_chars").isNotNull(), leaf(n_chars=more)).alias("altered")
    )
    made = write(rows, ["doc_id"], "lang", ["altered"])
    paths = made.proofs(made.leaves).select(F.col("tree").alias("of"), F.col("rank").alias("at"), F.col("digest").alias("found"), "proof")
    subroots = made.subroots.select(F.col("tree").alias("in"), F.col("digest").alias("subroot"))
    leaves = made.leaves.join(paths, F.col("tree").eqNullSafe(F.col("of")) & (F.col("rank") == F.col("at"))).join(
        subroots, F.col("tree").eqNullSafe(F.col("in"))
    )
    root = F.lit(made.root)
    folded = fold(F.coalesce("altered", "found"), F.col("proof"))
    return leaves.select(
        "doc_id", F.col("found").alias("leaf"), "subroot", root.alias("root"),
        F.sha2(F.array_join(F.transform("proof", lambda s: s["digest"]), ""), 256).alias("proof_sha256"),
        folded.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
