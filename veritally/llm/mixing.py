"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions.

A source's rows form blocks.  Every block gets a release time and a deadline
from its source's weight, and one slot at a time goes to the released block
of earliest deadline, so that at any time every source has received its
weighted share to within less than one block.

Weights are whole shares.  One frame of ``sum(shares)`` slots holds exactly
``share`` blocks of every source, so all frames with the same sources left
have the same schedule, which is computed once by a fold over the slots.
When sources run out, the frame shrinks to what is left; there are at most
two such changes per source.  A block's slot is then arithmetic on its
number, whatever the size of the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

BLOCK_ROWS = 64
DEFAULT_SHARE = 1
# Weights are given for named sources: more sources, or longer frames, are an error.
MAX_SOURCES = 2_000
MAX_FRAME = 20_000
RANGES = 1 << 16


def source_key(source: str = "source") -> Column:
    """A NULL source is a source of its own."""
    return F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))


def phases(blocks: dict[str, int], shares: dict[str, int]) -> list[tuple]:
    """(phase, first frame, first slot, blocks of each source in one frame), sources in order."""
    order = sorted(blocks)
    cuts = {0} | {blocks[s] // shares[s] + k for s in order for k in (0, 1)}
    out = []
    for f in sorted(cuts):
        left = [max(0, min(shares[s], blocks[s] - f * shares[s])) for s in order]
        if sum(left):
            out.append((len(out), f, sum(min(blocks[s], f * shares[s]) for s in order), left))
    return out


# Fold over the slots t of a frame.  ``took[s]`` blocks of source s are placed; the next one, number k, may start at
# floor(k * size / m) and must end by ceil((k + 1) * size / m).  Ties go to the first source.
_PICK = """
array_min(filter(transform(sequence(0, size(m) - 1), s -> CASE
  WHEN took[s] < m[s] AND (took[s] * frame) DIV m[s] <= t
  THEN struct((((took[s] + 1) * frame + m[s] - 1) DIV m[s]) AS deadline, s AS s) END), x -> x IS NOT NULL)).s
"""
_SCHEDULE = f"""
aggregate(
  sequence(0L, frame - 1),
  struct(transform(m, x -> 0L) AS took, CAST(array() AS array<int>) AS picks),
  (acc, t) -> transform(array(struct(acc.took AS took, acc.picks AS picks)), a -> transform(
    array(aggregate(array(1), a.took, (took, one) -> took, took -> {_PICK})),
    pick -> struct(
      transform(a.took, (n, s) -> IF(s = pick, n + 1, n)) AS took,
      concat(a.picks, array(pick)) AS picks))[0])[0],
  acc -> acc.picks)
"""


def mix(docs: DataFrame, shares: dict[str, int], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``docs(doc_id, source, ...)`` plus ``mix_block``, ``mix_release``,
    ``mix_deadline``, ``mix_slot`` (all in blocks) and ``mix_row`` (place in the block).

    No row is dropped or repeated: a source goes on until it is used up, and
    the others share its slots from then on.  Within a source, rows go by the
    md5 of their doc_id.  Sources without a share get ``DEFAULT_SHARE``; a
    NULL source is one of them.  An empty table gives an empty table; input
    columns with the added names are replaced.
    """
    spark = docs.sparkSession
    added = ["mix_block", "mix_release", "mix_deadline", "mix_slot", "mix_row"]
    base = docs.select(*[c for c in docs.columns if c not in added], source_key().alias("_mix_source"))
    counts = base.groupBy("_mix_source").agg(F.count("*").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(counts) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    wanted = {f"={s}": int(n) for s, n in shares.items()}
    if any(n < 1 for n in wanted.values()):
        raise ValueError("shares must be whole numbers of 1 or more")
    blocks = {r["_mix_source"]: -(-r["n"] // block_rows) for r in counts}
    own = {s: wanted.get(s, DEFAULT_SHARE) for s in blocks}
    if sum(own.values()) > MAX_FRAME:
        raise ValueError(f"a frame of more than {MAX_FRAME} slots")
    plan = phases(blocks, own)
    order = sorted(blocks)

    # Slots of every source in every phase: at most (2 * sources + 1) * frame numbers in all.
    table = spark.createDataFrame([(p, f, at, left) for p, f, at, left in plan], "p int, first long, at long, m array<long>")
    table = table.withColumn("frame", F.expr("aggregate(m, 0L, (a, x) -> a + x)")).withColumn("picks", F.expr(_SCHEDULE))
    names = spark.createDataFrame([(i, s, own[s]) for i, s in enumerate(order)], "i int, _mix_source string, _mix_share long")
    slots = table.select("p", "first", "at", "frame", "m", F.posexplode("picks").alias("t", "i"))
    slots = slots.groupBy("i", "p").agg(
        F.first("first").alias("first"), F.first("at").alias("at"), F.first("frame").alias("frame"),
        F.expr("first(m[i])").alias("m"), F.array_sort(F.collect_list(F.col("t").cast("long"))).alias("slots"),
    )
    per_source = names.join(
        slots.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("first", "at", "frame", "m", "slots"))).alias("_mix_phases")), "i"
    ).drop("i")

    # Rank in the source: ranges of the md5 keep every window small, counts of earlier ranges are added.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions")) * 4
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    base = base.withColumn("_mix_md5", digest)
    base = base.withColumn("_mix_range", F.floor(F.conv(F.substring("_mix_md5", 1, 4), 16, 10).cast("long") * parts / RANGES))
    within = Window.partitionBy("_mix_source", "_mix_range").orderBy("_mix_md5", "doc_id", *(["text"] if "text" in docs.columns else []))
    before = Window.partitionBy("_mix_source").orderBy("_mix_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = base.groupBy("_mix_source", "_mix_range").agg(F.count("*").alias("n")).select(
        "_mix_source", "_mix_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_mix_before")
    )
    ranked = base.withColumn("_mix_rank", F.row_number().over(within) - 1).join(offsets, ["_mix_source", "_mix_range"])
    # The broadcast table's size is bounded by MAX_SOURCES and MAX_FRAME above.
    placed = (
        ranked.join(F.broadcast(per_source), "_mix_source")
        .withColumn("_mix_rank", F.col("_mix_rank") + F.col("_mix_before"))
        .withColumn("mix_block", F.expr(f"_mix_rank DIV {block_rows}"))
        .withColumn("_mix_frame", F.expr("mix_block DIV _mix_share"))
        .withColumn("_mix_in", F.expr("mix_block % _mix_share"))
        .withColumn("_mix_p", F.expr("element_at(filter(_mix_phases, x -> x.first <= _mix_frame), -1)"))
        .withColumn("_mix_at", F.expr("_mix_p.at + (_mix_frame - _mix_p.first) * _mix_p.frame"))
        .withColumn("mix_release", F.expr("_mix_at + (_mix_in * _mix_p.frame) DIV _mix_p.m"))
        .withColumn("mix_deadline", F.expr("_mix_at + ((_mix_in + 1) * _mix_p.frame + _mix_p.m - 1) DIV _mix_p.m"))
        .withColumn("mix_slot", F.expr("_mix_at + _mix_p.slots[CAST(_mix_in AS int)]"))
        .withColumn("mix_row", F.expr(f"_mix_rank % {block_rows}"))
    )
    return placed.select(*[c for c in docs.columns if c not in added], *added)


def in_order(mixed: DataFrame) -> DataFrame:
    """Rows in the order of their slots: files written from it hold the mixture."""
    return mixed.orderBy("mix_slot", "mix_row")
