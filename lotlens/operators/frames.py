"""Per-frame views on the judged detail: the 12 x 24 grid of one (lot, frame,
item), its value levels, and its values along the machines' processing paths.

All frames are handled in one DataFrame; one frame is the same plan over the
folder and row groups that ``select_frame`` leaves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotlens.contracts import POSITION_X, POSITION_Y
from lotlens.functions.scalar import finite, padded_range
from lotlens.operators.kde import frames
from lotlens.operators.rows import judged_targets
from lotlens.sources.stages import select_frame

KEYS = ["lot_number", "FrameNo", "colname"]


def frame_grid(judged: DataFrame, lot: str | None = None, frame: int | None = None,
               colname: str | None = None, required: bool = False, days: DataFrame | None = None) -> DataFrame:
    """Dense 12 x 24 grid per (lot, frame, item) with rows: value, normalised
    value, NG direction (0 where a cell is empty) and lower/upper NG flags,
    plus the frame's limits, best, unit and row count.  With keys given, just
    that frame (the drill-down lookup; ``days`` as in ``select_frame``).  An empty selection has no rows, or
    raises ValueError if ``required``."""
    chosen = select_frame(judged, lot, frame, colname, days)
    if required and judged_targets(chosen).isEmpty():
        raise ValueError("no measurements in the selection")
    rows = frames(chosen)
    every = F.array(*[F.lit(y * 256 + x) for y in POSITION_Y for x in POSITION_X])
    held = F.transform("cells", lambda c: c["PositionY"].cast("int") * 256 + c["PositionX"].cast("int"))
    empty = F.transform(F.array_except(every, held), lambda k: F.struct(
        F.shiftright(k, 8).cast("tinyint").alias("PositionY"), (k % 256).cast("tinyint").alias("PositionX"),
        F.lit(None).cast("double").alias("value"), F.lit(None).cast("double").alias("normalized_value"),
        F.lit(0).cast("tinyint").alias("ng_direction")))
    full = F.transform("cells", lambda c: F.struct(
        c["PositionY"].alias("PositionY"), c["PositionX"].alias("PositionX"), c["value"].alias("value"),
        c["normalized_value"].alias("normalized_value"),
        F.coalesce(c["ng_direction"], F.lit(0).cast("tinyint")).alias("ng_direction")))
    grid = rows.select(*KEYS, F.explode_outer(F.concat(full, empty)).alias("c"), "spec_lower", "spec_upper", "spec_best",
                       "meta_unit", F.col("row_count").alias("sample_count"))
    return grid.select(*KEYS, "c.PositionY", "c.PositionX", "c.value", "c.normalized_value", "c.ng_direction",
                       (F.col("c.ng_direction") == -1).alias("lower_ng"), (F.col("c.ng_direction") == 1).alias("upper_ng"),
                       "spec_lower", "spec_upper", "spec_best", "meta_unit", "sample_count")


def frame_value_levels(judged: DataFrame) -> DataFrame:
    """Per frame grid: colour levels = raw min/max padded by 4% of
    max(span, |max| x 1%, 1e-9)."""
    rows = frames(judged).withColumn("values", F.filter(F.transform("cells", lambda c: c["value"]), finite))
    g = rows.filter(F.size("values") > 0).select(
        *KEYS, F.array_min("values").alias("raw_min"), F.array_max("values").alias("raw_max"))
    lo, hi = padded_range(F.col("raw_min"), F.col("raw_max"))
    return g.select(*KEYS, "raw_min", "raw_max", lo.alias("level_min"), hi.alias("level_max"))


def path_series(grid: DataFrame, catalog: DataFrame, equipment_id: str | None = None) -> DataFrame:
    """Values of every frame grid along each processing path of a machine
    (all machines when ``equipment_id`` is None): equi-join of the grid cells
    to the path cells on (X, Y) (the join's form is Spark's choice).  Empty cells stay null (direction 0)."""
    paths = catalog if equipment_id is None else catalog.filter(F.col("equipment_id") == equipment_id)
    paths = paths.select("equipment_id", "path_index", "path_id", "label", "step",
                         F.col("PositionX").cast("tinyint").alias("PositionX"),
                         F.col("PositionY").cast("tinyint").alias("PositionY"))
    j = grid.join(paths, ["PositionX", "PositionY"], "inner")
    return j.select(*KEYS, "equipment_id", "path_index", "path_id", "label", "step", "PositionX",
                    "PositionY", "value", "ng_direction", "spec_lower", "spec_upper")


def path_plot_range(series: DataFrame) -> DataFrame:
    """Per (frame grid, machine): x = steps +-3% of max(1, span); y = finite
    values and finite limits +-8% of max(1e-9, span)."""
    keys = [*KEYS, "equipment_id"]
    lims = [F.when(finite(c), F.col(c)) for c in ("spec_lower", "spec_upper")]
    g = series.groupBy(*keys).agg(
        F.min("step").alias("x_lo"), F.max("step").alias("x_hi"),
        F.min(F.when(finite("value"), F.col("value"))).alias("v_lo"),
        F.max(F.when(finite("value"), F.col("value"))).alias("v_hi"),
        F.min(lims[0]).alias("l_lo"), F.max(lims[0]).alias("l_hi"),
        F.min(lims[1]).alias("u_lo"), F.max(lims[1]).alias("u_hi"))
    y_lo = F.least("v_lo", "l_lo", "u_lo")
    y_hi = F.greatest("v_hi", "l_hi", "u_hi")
    x_span = F.greatest(F.lit(1.0), (F.col("x_hi") - F.col("x_lo")).cast("double"))
    g = g.withColumns({"y_lo": y_lo, "y_hi": y_hi})
    y_span = F.greatest(F.lit(1e-9), F.col("y_hi") - F.col("y_lo"))
    return g.select(*keys,
                    (F.col("x_lo") - x_span * F.lit(0.03)).alias("x_min"),
                    (F.col("x_hi") + x_span * F.lit(0.03)).alias("x_max"),
                    (F.col("y_lo") - y_span * F.lit(0.08)).alias("y_min"),
                    (F.col("y_hi") + y_span * F.lit(0.08)).alias("y_max"))
