"""Data contracts checked as DataFrames (one row per checked unit, with flags).

Each check is an aggregate, so it runs distributed and returns a small
result; a check passes when its ``ok`` column is true everywhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotlens.contracts import FRAME_CELLS, POSITION_X, POSITION_Y
from lotlens.operators.aggregates import QUANTILE_NAMES, QUANTILES
from lotlens.operators.rows import judged_targets


def row_count_check(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per lot: rows in vs rows out of a stage (full outer join of two per-lot
    counts; a lot missing on either side shows up with a zero)."""
    a = before.groupBy("lot_number").agg(F.count(F.lit(1)).alias("rows_in"))
    b = after.groupBy("lot_number").agg(F.count(F.lit(1)).alias("rows_out"))
    j = a.join(b, "lot_number", "full_outer").fillna(0, ["rows_in", "rows_out"])
    return j.withColumn("ok", F.col("rows_in") == F.col("rows_out"))


def unit_consistency(judged: DataFrame) -> DataFrame:
    """Per target item: no null unit and at most one distinct unit."""
    g = judged_targets(judged).groupBy("colname").agg(
        F.count_if(F.col("meta_unit").isNull()).alias("null_units"),
        F.count_distinct("meta_unit").alias("distinct_units"),
    )
    return g.withColumn("ok", (F.col("null_units") == 0) & (F.col("distinct_units") <= 1))


def nonnegative_check(df: DataFrame, categories: tuple[str, ...] | list[str]) -> DataFrame:
    """Per category in ``categories``: row count, minimum value, negatives."""
    g = df.filter(F.col("meta_category").isin(list(categories))).groupBy("meta_category").agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("value").alias("min_value"),
        F.count_if(F.col("value") < 0).alias("negatives"),
    )
    return g.withColumn("ok", F.col("negatives") == 0)


def frame_completeness(judged: DataFrame) -> DataFrame:
    """Per (lot, frame, item): rows, distinct cells and X/Y ranges; complete
    when it holds exactly the 288 cells of the 24 x 12 grid once each."""
    g = judged_targets(judged).groupBy("lot_number", "FrameNo", "colname").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct("PositionX", "PositionY").alias("cells"),
        F.min("PositionX").alias("min_x"), F.max("PositionX").alias("max_x"),
        F.min("PositionY").alias("min_y"), F.max("PositionY").alias("max_y"),
    )
    return g.withColumn(
        "complete",
        (F.col("rows") == FRAME_CELLS) & (F.col("cells") == FRAME_CELLS)
        & (F.col("min_x") == POSITION_X[0]) & (F.col("max_x") == POSITION_X[-1])
        & (F.col("min_y") == POSITION_Y[0]) & (F.col("max_y") == POSITION_Y[-1]))


def quantile_monotone(frame_stats: DataFrame) -> DataFrame:
    """Per item: frame rows and rows breaking min <= P05 <= ... <= P95 <= max."""
    chain = ["minimum", *QUANTILE_NAMES, "maximum"]
    broken = F.lit(False)
    for a, b in zip(chain, chain[1:]):
        broken = broken | F.coalesce(F.col(a) > F.col(b), F.lit(False))
    g = frame_stats.groupBy("colname").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(broken).alias("violations"))
    return g.withColumn("ok", F.col("violations") == 0)


def source_reconcile(judged: DataFrame, frame_stats: DataFrame, tol: float = 1e-9) -> DataFrame:
    """Recompute N, NG and the quantiles of every (lot, frame, item) cell from
    the detail (target rows) and compare with the stored pre-aggregate.
    Per item: cells compared and mismatching cells (a cell missing on one
    side is a mismatch)."""
    qs = ", ".join(f"percentile_cont({p}) WITHIN GROUP (ORDER BY value) AS {n}"
                   for p, n in zip(QUANTILES, QUANTILE_NAMES))
    detail = judged_targets(judged).groupBy("lot_number", "FrameNo", "colname").agg(
        F.count("value").alias("n_detail"),
        F.count_if(F.col("is_ng")).alias("ng_detail"),
        *[F.expr(q.strip()) for q in qs.split(", ")],
    )
    detail = detail.select("lot_number", "FrameNo", "colname", "n_detail", "ng_detail",
                           *[F.col(n).alias(f"{n}_detail") for n in QUANTILE_NAMES])
    stored = frame_stats.select("lot_number", "FrameNo", "colname", "sample_count", "ng_count",
                                *QUANTILE_NAMES)
    j = detail.join(stored, ["lot_number", "FrameNo", "colname"], "full_outer")
    same = (F.col("n_detail") == F.col("sample_count")) & (F.col("ng_detail") == F.col("ng_count"))
    for n in QUANTILE_NAMES:
        a, b = F.col(f"{n}_detail"), F.col(n)
        same = same & ((a.isNull() & b.isNull()) | F.coalesce(F.abs(a - b) <= tol, F.lit(False)))
    same = F.coalesce(same, F.lit(False))
    g = j.groupBy("colname").agg(F.count(F.lit(1)).alias("cells"),
                                 F.count_if(~same).alias("mismatches"))
    return g.withColumn("ok", F.col("mismatches") == 0)
