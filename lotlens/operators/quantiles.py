"""Exact percentiles for groups of unbounded size.

``percentile`` keeps a value -> count map per group and merges it in one
task, which is fine for the frame grain (a group is at most the 288 cells of
one frame) but not for a level taken over every cell of every lot.  This
operator stays exact without ever gathering a group:

1. a small quantile sketch per group (``ACCURACY`` samples, map-side merged)
   brackets the wanted ranks between two of ``GRID`` evenly spaced quantiles;
   further ``ROUNDS`` sketch only the values inside, and count exactly what lies
   below.  A round leaves about 1/GRID + 4/ACCURACY of the values.
2. The few values left are counted per distinct value (ties collapse
   map-side, and so does everything below the bracket, into one row); a running
   count finds the exact order statistics, and the
   result is ``v[floor(k)] + (v[ceil(k)] - v[floor(k)]) * (k - floor(k))``
   with ``k = p (n - 1)`` -- the linear interpolation of ``percentile``.

The sketch's error bound makes every bracket hold its ranks.  Should one not,
the query fails; it never returns an approximation or a null instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 2000
GRID = 400
ROUNDS = 2


def _bracket(seen: DataFrame, gk: list[str], accuracy: int, grid: int) -> DataFrame:
    """(group, _k, _lo, _hi) from a sketch ``_q`` over ``_n`` values that have ``_below`` others before them."""
    slack = 2.0 / accuracy
    low = F.floor(((F.floor("_k") - F.col("_below")) / F.col("_n") - slack) * grid).cast("int")
    high = F.ceil(((F.ceil("_k") + 1 - F.col("_below")) / F.col("_n") + slack) * grid).cast("int")
    return seen.select(
        *gk, "_k",
        F.when(low <= 0, F.col("_min")).otherwise(F.get("_q", low)).alias("_lo"),
        F.when(high >= grid, F.col("_max")).otherwise(F.get("_q", high)).alias("_hi"))


def exact_percentile(df: DataFrame, keys: list[str], value: str, p: float,
                     accuracy: int = ACCURACY, name: str = "percentile",
                     few_groups: bool = False, rounds: int = ROUNDS, grid: int = GRID) -> DataFrame:
    """One row per group of ``keys`` that holds a value (``keys`` may be empty:
    one global row): ``name`` = exact linear-interpolated ``p``-percentile of
    the non-null, non-NaN ``value``.  ``few_groups`` promises a group count with a proven
    bound (items of a checked master, or one global row): its table of one row per
    group is then broadcast instead of shuffling the values to meet it."""
    if not 0.0 <= p <= 1.0:
        raise ValueError("p must be within [0, 1]")
    gk = list(keys) or ["_all"]
    base = df.select(*keys, F.col(value).cast("double").alias("_v"))
    if not keys:
        base, few_groups = base.withColumn("_all", F.lit(0)), True
    base = base.filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    steps = F.array(*[F.lit(k / grid) for k in range(grid + 1)])
    seen = base.groupBy(*gk).agg(
        (F.lit(p) * (F.count(F.lit(1)) - 1)).alias("_k"), F.lit(0).cast("long").alias("_below"),
        F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"),
        F.percentile_approx("_v", steps, accuracy).alias("_q"))
    bracket = _bracket(seen, gk, accuracy, grid)

    def up_to(bracket: DataFrame) -> DataFrame:
        return base.join(F.broadcast(bracket) if few_groups else bracket, gk).filter(F.col("_v") <= F.col("_hi"))

    for _ in range(rounds - 1):
        inside = F.when(F.col("_v") >= F.col("_lo"), F.col("_v"))
        seen = up_to(bracket).groupBy(*gk, "_k").agg(
            F.count_if(F.col("_v") < F.col("_lo")).alias("_below"), F.count(inside).alias("_n"),
            F.min(inside).alias("_min"), F.max(inside).alias("_max"),
            F.percentile_approx(inside, steps, accuracy).alias("_q"))
        bracket = _bracket(seen, gk, accuracy, grid)
    lowest = F.lit(float("-inf"))
    left = (up_to(bracket).withColumn("_v", F.when(F.col("_v") < F.col("_lo"), lowest).otherwise(F.col("_v")))
            .groupBy(*gk, "_k", "_lo", "_v").agg(F.count(F.lit(1)).alias("_c")))
    w = Window.partitionBy(*gk).orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = left.withColumn("_to", F.sum("_c").over(w))
    out = counted.groupBy(*gk, "_k", "_lo").agg(
        F.min(F.when(F.col("_to") > F.floor("_k"), F.col("_v"))).alias("_v0"),
        F.min(F.when(F.col("_to") > F.ceil("_k"), F.col("_v"))).alias("_v1"))
    held = (F.col("_v0") >= F.col("_lo")) & F.col("_v1").isNotNull()
    between = F.col("_v0") + (F.col("_v1") - F.col("_v0")) * (F.col("_k") - F.floor("_k"))
    result = (F.when(~F.coalesce(held, F.lit(False)),
                     F.raise_error(F.lit("a quantile bracket does not hold its rank")).cast("double"))
              .when(F.col("_v0") == F.col("_v1"), F.col("_v0")).otherwise(between))
    return out.select(*keys, result.alias(name))
