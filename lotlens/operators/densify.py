"""Dense key grids (items x lots x frames / cells / bins) without cross joins.

Every grid is built by ``explode`` of literal arrays (the item master, the
frame numbers, the 24 x 12 cells, the bin indexes) onto a data-derived key
table, then measured values are attached by an equi left join.  Densify
happens only after aggregation, never on detail rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lotlens.contracts import FRAME_NUMBERS, POSITION_X, POSITION_Y, check_item_names


def indexed_lots(lots_df: DataFrame) -> DataFrame:
    """Lots in start-time order with a 0-based ``lot_index``.

    Lots are numbered within their start day, all days at once; what the days
    before hold is added from the lot counts per day.  Only those counts, a row per
    calendar day, pass one task.
    """
    lots_df = lots_df.select("lot_number", "lot_start_time", F.to_date("lot_start_time").alias("_day"))
    per_day = lots_df.groupBy("_day").agg(F.count(F.lit(1)).alias("_lots"))
    earlier = Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    before = per_day.select(F.col("_day").alias("_of"), F.coalesce(F.sum("_lots").over(earlier), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_day").orderBy("lot_start_time", "lot_number")
    return (lots_df.withColumn("_at", F.row_number().over(within))
            .join(before, F.col("_day").eqNullSafe(F.col("_of")))
            .select("lot_number", "lot_start_time", (F.col("_before") + F.col("_at") - 1).cast("int").alias("lot_index")))


def present_items(df: DataFrame, known: tuple[str, ...]) -> DataFrame:
    """Known items that occur in ``df`` (at most len(known) <= 63 rows, checked)."""
    check_item_names(known)
    return df.filter(F.col("colname").isin(list(known))).select("colname").distinct()


def item_lot_grid(lots_idx: DataFrame, present: DataFrame, known: tuple[str, ...]) -> DataFrame:
    """lots x present items, items carrying their ``spec_order`` (index in ``known``)
    and whatever ``present`` (a row per item) knows of them."""
    check_item_names(known)
    items = F.array(*[F.struct(F.lit(i).alias("spec_order"), F.lit(c).alias("colname"))
                      for i, c in enumerate(known)])
    g = lots_idx.select("*", F.explode(items).alias("_item")).select(
        *lots_idx.columns, F.col("_item.colname").alias("colname"),
        F.col("_item.spec_order").alias("spec_order"))
    return g.join(F.broadcast(present), "colname")


def with_frames(grid: DataFrame) -> DataFrame:
    return grid.withColumn("FrameNo", F.explode(
        F.sequence(F.lit(FRAME_NUMBERS[0]), F.lit(FRAME_NUMBERS[-1])).cast("array<smallint>")))


def with_cells(grid: DataFrame) -> DataFrame:
    """Every (PositionY, PositionX) of the 12 x 24 frame grid per key row."""
    return (grid
            .withColumn("PositionY", F.explode(
                F.sequence(F.lit(POSITION_Y[0]), F.lit(POSITION_Y[-1])).cast("array<tinyint>")))
            .withColumn("PositionX", F.explode(
                F.sequence(F.lit(POSITION_X[0]), F.lit(POSITION_X[-1])).cast("array<tinyint>"))))
