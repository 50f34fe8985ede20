"""Exact percentiles of groups of any size, in one lazy plan.

The built-in exact ``percentile`` keeps every distinct value of a group in one
task.  Here a mergeable sketch brackets each wanted rank; one more pass counts
the values below the bracket and in equal slices of it, and only the slices
that hold a wanted rank are ordered.  The answer is exact, rows are combined
before every shuffle, and no task holds more than a slice of a bracket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

# Sketch size; its rank error is at most rows / ACCURACY.
ACCURACY = 20_000
# Four times the sketch's error: the bracket cannot miss by more than the one
# rank on either side that is kept besides it.
MARGIN = 4
SLICES = 1_024


def attach(rows: DataFrame, table: DataFrame, by: Sequence[str], columns: Sequence[str], how: str = "inner") -> DataFrame:
    """``rows`` with ``columns`` of the ``table`` row of their group; NULL is a
    group.  With ``by=()`` the table's only row is a value for all rows."""
    if not by:
        one = table.select(F.struct(*columns).alias("_one")).scalar()
        return rows.withColumn("_one", one).select(*rows.columns, *[F.col(f"_one.{c}").alias(c) for c in columns])
    right = table.select(*[F.col(c).alias(f"_k_{c}") for c in by], *columns)
    on = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in by]
    return rows.join(right, on, how).drop(*[f"_k_{c}" for c in by])


def _summary(df: DataFrame, by: Sequence[str], value: str, fractions: Sequence[float], stats) -> DataFrame:
    """Size, caller's statistics, and per fraction the bracket, the two ranks and the weight between them."""
    points = []
    for p in fractions:
        points += [max(0.0, p - MARGIN / ACCURACY), min(1.0, p + MARGIN / ACCURACY)]
    odd = F.isnan(F.col(value).cast("double"))
    v = F.when(~odd, F.col(value).cast("double"))
    first = df.groupBy(*by).agg(
        F.count(v).alias("_n"), F.count_if(odd).alias("_nan"), F.percentile_approx(v, points, ACCURACY).alias("_cuts"), *stats
    )
    brackets = []
    for i, p in enumerate(fractions):
        position = F.lit(float(p)) * (F.col("_n") - 1)
        low = F.floor(position).cast("long")
        brackets.append(F.struct(
            F.lit(i).alias("i"), F.get("_cuts", F.lit(2 * i)).alias("lo"), F.get("_cuts", F.lit(2 * i + 1)).alias("hi"),
            low.alias("low"), F.least(low + 1, F.col("_n") - 1).alias("high"), (position - low).alias("t"),
        ))
    return first.withColumn("_b", F.array(*brackets)).drop("_cuts")


def _at_ranks(values: DataFrame, summary: DataFrame, by: Sequence[str], value: str, names: Sequence[str]) -> DataFrame:
    """One column per fraction, for every group with values."""
    v, b = F.col(value).cast("double"), F.col("_b")
    plain = values.where(v.isNotNull() & ~F.isnan(v))
    rows = attach(plain, summary.where("_n > 0"), by, ["_b"]).select(*by, v.alias("_x"), F.explode("_b").alias("_b"))
    x = F.col("_x")
    part = F.when(b["hi"] > b["lo"], F.floor((x - b["lo"]) / (b["hi"] - b["lo"]) * SLICES)).otherwise(0)
    place = F.when(x < b["lo"], -1).when(x > b["hi"], SLICES).otherwise(F.least(part, F.lit(SLICES - 1))).cast("int")
    inside = F.col("_s").between(0, SLICES - 1)
    # Outside the bracket one entry is left per side: its count and its value next to the bracket.
    state = rows.withColumn("_s", place).groupBy(*by, "_b", "_s", F.when(inside, x).alias("_v")).agg(
        F.count(F.lit(1)).alias("_c"), F.min("_x").alias("_first"), F.max("_x").alias("_last")
    )
    totals = state.groupBy(*by, "_b", "_s").agg(F.sum("_c").alias("_size"))
    order = Window.partitionBy(*by, "_b.i").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_before", F.coalesce(F.sum("_size").over(order), F.lit(0)))
    wanted = totals.where((F.col("_before") <= b["high"]) & (F.col("_before") + F.col("_size") > b["low"]))
    keys = [*by, "_i", "_s"]
    picked = attach(
        state.withColumn("_i", b["i"]), wanted.withColumn("_i", b["i"]), keys, ["_before", "_size"]
    )
    within = Window.partitionBy(*keys).orderBy("_first").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    picked = picked.withColumn("_upto", F.col("_before") + F.sum("_c").over(within))
    missed = F.raise_error(F.lit("the sketch missed a rank by more than its error")).cast("double")

    def at(rank: str) -> Column:
        r = b[rank]
        here = (r >= F.col("_before")) & (r < F.col("_before") + F.col("_size"))
        edge = F.when(F.col("_s") < 0, F.when(r == F.col("_upto") - 1, F.col("_last")).otherwise(missed)).otherwise(
            F.when(r == F.col("_before"), F.col("_first")).otherwise(missed)
        )
        # The first distinct value of the slice whose running count passes the rank.
        return F.min(F.when(here & F.when(inside, F.col("_upto") > r).otherwise(True), F.when(inside, F.col("_v")).otherwise(edge)))

    found = picked.groupBy(*by, "_i", "_b").agg(at("low").alias("_lower"), at("high").alias("_upper"))
    q = F.col("_lower") + (F.col("_upper") - F.col("_lower")) * b["t"]
    return found.groupBy(*by).agg(*[F.max(F.when(F.col("_i") == i, q)).alias(n) for i, n in enumerate(names)])


def exact_percentiles(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    fractions: Sequence[float],
    names: Sequence[str],
    stats: Sequence[Column] = (),
) -> DataFrame:
    """One row per group: ``by``, the extra ``stats`` and one exact,
    interpolated percentile per fraction.

    NULL values have no rank; a group with a NaN has NaN percentiles, one
    without values NULL.  A NULL key is a group.  ``stats`` are aggregates
    over the rows of ``df``; they ride along in the first pass.
    """
    by = list(by)
    values = df.select(*dict.fromkeys((*by, value)))
    summary = _summary(df, by, value, fractions, stats)
    found = _at_ranks(values, summary, by, value, names)
    out = attach(summary, found, by, names, "left")
    nan = F.lit(float("nan"))
    return out.withColumns({n: F.when(F.col("_nan") > 0, nan).otherwise(F.col(n)) for n in names}).drop("_n", "_nan", "_b")
