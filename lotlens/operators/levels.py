"""Display levels derived from the views (colour scales, axis ranges)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotlens.functions.scalar import finite, nice_upper
from lotlens.operators.quantiles import exact_percentile

LEVEL_PERCENTILE = 0.995
LEVEL_MINIMUM = {"ng_rate": 1.0, "normalized_mean": 0.1, "normalized_std": 0.1}


def metric_levels(cells: DataFrame, keys: list[str], few_groups: bool = False) -> DataFrame:
    """Colour maxima per group of ``keys`` (none = one global row): the exact
    99.5th percentile of each metric over the group's cells (empty cells
    ignored), rounded up by ``nice_upper``.  The three metrics are unpivoted so
    one distributed exact-percentile pass serves all of them; no group is ever
    gathered into one task."""
    long = cells.unpivot(ids=keys, values=list(LEVEL_MINIMUM), variableColumnName="_metric",
                         valueColumnName="_x")
    pct = exact_percentile(long, [*keys, "_metric"], "_x", LEVEL_PERCENTILE, name="_p", few_groups=few_groups)
    wide = pct.groupBy(*keys).pivot("_metric", list(LEVEL_MINIMUM)).agg(F.first("_p"))
    return wide.select(*keys, *[nice_upper(F.col(m), lo).alias(f"{m}_max") for m, lo in LEVEL_MINIMUM.items()])


def color_levels(frame_map: DataFrame) -> DataFrame:
    """Per item: colour maxima of the position map over every lot x cell."""
    items = frame_map.select("colname").distinct()
    # the map holds the items of a checked master (at most 63)
    return items.join(metric_levels(frame_map, ["colname"], few_groups=True), "colname", "left")


def trend_y_range(trend: DataFrame) -> DataFrame:
    """Per item: y range of the trend chart over all lots -- min/max of the
    minimum and maximum series and the finite limits, padded by 8% of the
    span, or by max(|max| x 5%, 1) when the span is 0."""
    lo_l, hi_l = [F.when(finite(c), F.col(c)) for c in ("spec_lower", "spec_upper")]
    g = trend.groupBy("colname").agg(
        F.min("minimum").alias("a"), F.max("minimum").alias("b"),
        F.min("maximum").alias("c"), F.max("maximum").alias("d"),
        F.min(lo_l).alias("l"), F.min(hi_l).alias("u"))
    lo = F.least("a", "c", "l", "u")
    hi = F.greatest("b", "d", "l", "u")
    g = g.withColumns({"_lo": lo, "_hi": hi})
    span = F.col("_hi") - F.col("_lo")
    pad = F.when(span > 0, span * F.lit(0.08)).otherwise(
        F.greatest(F.abs(F.col("_hi")) * F.lit(0.05), F.lit(1.0)))
    return g.select("colname", (F.col("_lo") - pad).alias("y_min"), (F.col("_hi") + pad).alias("y_max"))
