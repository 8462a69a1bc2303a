"""The five analysis grains (plus the global item bounds behind the histogram).

Every grain is one ``groupBy().agg()``: Spark plans a partial (map-side)
aggregate, one shuffle on the grouping keys and a final aggregate, so a hot
lot or item is combined inside each map task before anything moves.  No
grain repartitions the detail by lot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotlens.contracts import KDE_BINS
from lotlens.functions.scalar import bit_lookup, floor_bin, spec_display_range
from lotlens.operators.rows import judged_targets

#: Rows of item bounds that are broadcast at most (some hundred kilobytes; an item master has 63).
MAX_ITEMS = 4096

QUANTILES = (0.05, 0.25, 0.50, 0.75, 0.95)
QUANTILE_NAMES = ("p05", "p25", "p50", "p75", "p95")

FRAME_STATS_COLUMNS = (
    "lot_number", "lot_start_time", "FrameNo", "vision", "colname", "meta_category",
    "meta_unit", "spec_lower", "spec_upper", "spec_best", "total_count", "sample_count",
    "ng_count", "ng_rate", "normalized_mean", "normalized_std", "minimum", *QUANTILE_NAMES,
    "maximum",
)
POSITION_STATS_COLUMNS = (
    "lot_number", "lot_start_time", "vision", "colname", "meta_category", "meta_unit",
    "PositionX", "PositionY", "total_count", "sample_count", "ng_count", "ng_rate",
    "normalized_mean", "normalized_std",
)
HISTOGRAM_COLUMNS = (
    "lot_number", "lot_start_time", "colname", "bin_index", "plot_min", "plot_max",
    "spec_lower", "spec_upper", "spec_best", "count", "bin_left", "bin_right", "bin_center",
)
PIECE_COLUMNS = (
    "lot_number", "lot_start_time", "FrameNo", "PositionX", "PositionY",
    "total_item_count", "ng_item_count", "ng_mask", "is_ng",
)


def _smallest_text(column: str):
    """min() of a text column that has one value, or very few, per group: an
    object-hash aggregate, where min() over strings would sort the detail."""
    return F.array_min(F.collect_set(column)).alias(column)


def _counts():
    """Shared count/rate/normalised metrics of the frame and position grains."""
    ng = F.count_if(F.col("is_ng"))
    total = F.count(F.lit(1))
    return [
        total.alias("total_count"),
        F.count("value").alias("sample_count"),
        ng.alias("ng_count"),
        (F.lit(100.0) * ng / total).alias("ng_rate"),
        F.avg("normalized_deviation").alias("normalized_mean"),
        F.stddev_pop("normalized_value").alias("normalized_std"),
    ]


def lots(judged: DataFrame) -> DataFrame:
    """lot -> start time over **all** rows (targets or not)."""
    return judged.groupBy("lot_number").agg(F.min("lot_start_time").alias("lot_start_time"))


def frame_item_stats(judged: DataFrame) -> DataFrame:
    """(lot, FrameNo, vision, colname) statistics over target rows, with exact
    linear-interpolated quantiles from one ``percentile`` call.

    An exact quantile needs all values of its group, so combining before the shuffle would save nothing but
    cost a pass over object buffers: the rows go to their frame (a few hundred each) first.
    """
    q = F.percentile(F.col("value"), F.array(*[F.lit(p) for p in QUANTILES]))
    dealt = judged_targets(judged).repartition("lot_number", "FrameNo", "colname")
    agg = dealt.groupBy("lot_number", "FrameNo", "vision", "colname").agg(
        F.min("lot_start_time").alias("lot_start_time"),
        _smallest_text("meta_category"),
        _smallest_text("meta_unit"),
        F.min("limmin").alias("spec_lower"),
        F.max("limmax").alias("spec_upper"),
        F.min("meta_best").alias("spec_best"),
        *_counts(),
        F.min("value").alias("minimum"),
        q.alias("_q"),
        F.max("value").alias("maximum"),
    )
    agg = agg.withColumns({n: F.col("_q")[i] for i, n in enumerate(QUANTILE_NAMES)})
    return agg.select(*FRAME_STATS_COLUMNS)


def _text_values(rows: DataFrame, *columns: str) -> dict:
    """Per text column its sorted values in ``rows``, as one scalar (few: they come from the item master).

    A group's smallest text is then its smallest position in that list, a plain number: the groups
    need neither object buffers nor a sort."""
    lists = (rows.select(*columns).distinct()
             .agg(F.struct(*[F.array_sort(F.collect_set(c)).alias(c) for c in columns])).scalar())
    return {c: lists[c] for c in columns}


def position_item_stats(judged: DataFrame) -> DataFrame:
    """(lot, vision, colname, X, Y) statistics across frames over target rows: one hash aggregate, one shuffle."""
    # of all rows, not only targets: more texts change no order, and nothing but the two columns is read
    texts = _text_values(judged, "meta_category", "meta_unit")
    agg = judged_targets(judged).groupBy("lot_number", "vision", "colname", "PositionX", "PositionY").agg(
        F.min("lot_start_time").alias("lot_start_time"),
        *[F.min(F.array_position(values, F.col(c))).alias(f"_{c}") for c, values in texts.items()],
        *_counts())
    agg = agg.withColumns({c: F.get(values, (F.col(f"_{c}") - 1).cast("int")) for c, values in texts.items()})
    return agg.select(*POSITION_STATS_COLUMNS)


def item_bounds(judged: DataFrame) -> DataFrame:
    """Global per-item value range and limits -> display range (plot_min/max).

    One row per colname; the only cross-lot aggregate.
    """
    return _display_bounds(judged_targets(judged), "value", "value", "limmin", "limmax", "meta_best")


def item_bounds_of(frame_stats: DataFrame) -> DataFrame:
    """``item_bounds`` from the frame statistics of the same rows: their extremes are those of the detail."""
    return _display_bounds(frame_stats, "minimum", "maximum", "spec_lower", "spec_upper", "spec_best")


def _display_bounds(rows: DataFrame, low: str, high: str, lower: str, upper: str, best_value: str) -> DataFrame:
    stats = rows.groupBy("colname").agg(
        F.min(low).alias("value_min"),
        F.max(high).alias("value_max"),
        F.min(lower).alias("spec_lower"),
        F.max(upper).alias("spec_upper"),
        F.min(best_value).alias("spec_best"),
    )
    vmin, vmax = F.col("value_min"), F.col("value_max")
    lo, hi, best = F.col("spec_lower"), F.col("spec_upper"), F.col("spec_best")
    raw_min = F.least(vmin, F.coalesce(lo, vmin), F.coalesce(hi, vmin))
    raw_max = F.greatest(vmax, F.coalesce(lo, vmax), F.coalesce(hi, vmax))
    stats = stats.withColumns({"raw_min": raw_min, "raw_max": raw_max})
    plot_min, plot_max = spec_display_range(lo, hi, best, F.col("raw_min"), F.col("raw_max"))
    return stats.withColumns({"plot_min": plot_min, "plot_max": plot_max})


def bin_edges(plot_min, plot_max, bin_index, bins: int):
    """Left/right/centre of a lot-histogram bin (null for the out-of-range bin)."""
    span = plot_max - plot_min
    b = bin_index.cast("double")
    ok = bin_index.isNotNull()
    return (
        F.when(ok, plot_min + span * b / F.lit(float(bins))),
        F.when(ok, plot_min + span * (b + F.lit(1.0)) / F.lit(float(bins))),
        F.when(ok, plot_min + span * (b + F.lit(0.5)) / F.lit(float(bins))),
    )


def checked_bounds(bounds: DataFrame) -> DataFrame:
    """``bounds`` for a broadcast: more than ``MAX_ITEMS`` items are an error, raised where the rows are made."""
    fields = ("colname", "plot_min", "plot_max", "spec_lower", "spec_upper", "spec_best")
    every = F.collect_list(F.struct(*fields))
    few = F.when(F.size("all") <= MAX_ITEMS, F.col("all")).otherwise(
        F.raise_error(F.lit(f"more than {MAX_ITEMS} items")).cast(bounds.agg(every.alias("all")).schema["all"].dataType))
    return bounds.agg(every.alias("all")).select(F.inline(few))


def lot_item_histogram(judged: DataFrame, bins: int = KDE_BINS, bounds: DataFrame | None = None) -> DataFrame:
    """Counts per (lot, colname, bin) on the item's global display range.

    Values outside the range (or missing) fall in the null bin; empty bins are
    not stored.  ``bounds`` is ``item_bounds(judged)`` (or ``item_bounds_of`` the frame
    statistics): a row per item, their number checked, so they are broadcast and the detail is
    binned where it is read and combined before the only shuffle.
    """
    if bins < 2:
        raise ValueError("bins must be >= 2")
    bounds = checked_bounds(item_bounds(judged) if bounds is None else bounds)
    indexed = judged_targets(judged).join(F.broadcast(bounds), "colname", "inner")
    indexed = indexed.withColumn(
        "bin_index", floor_bin(F.col("value"), F.col("plot_min"), F.col("plot_max"), bins))
    grouped = indexed.groupBy("lot_number", "colname", "bin_index").agg(
        F.min("lot_start_time").alias("lot_start_time"),
        *[F.min(c).alias(c) for c in ("plot_min", "plot_max", "spec_lower", "spec_upper", "spec_best")],
        F.count(F.lit(1)).alias("count"))
    left, right, centre = bin_edges(F.col("plot_min"), F.col("plot_max"), F.col("bin_index"), bins)
    return grouped.withColumns({"bin_left": left, "bin_right": right, "bin_center": centre}) \
        .select(*HISTOGRAM_COLUMNS)


def piece_ng(judged: DataFrame, bit_items: tuple[str, ...] | list[str]) -> DataFrame:
    """Per piece (lot, frame, X, Y): item count, NG item count and the OR of
    the NG items' bits (bit = index in ``bit_items``; unknown items add 0)."""
    bit = bit_lookup(F.col("colname"), tuple(bit_items))
    agg = judged_targets(judged).groupBy("lot_number", "FrameNo", "PositionX", "PositionY").agg(
        F.min("lot_start_time").alias("lot_start_time"),
        F.count(F.lit(1)).alias("total_item_count"),
        F.count_if(F.col("is_ng")).alias("ng_item_count"),
        F.bit_or(F.when(F.col("is_ng"), bit).otherwise(F.lit(0).cast("long"))).alias("ng_mask"),
    )
    return agg.withColumn("is_ng", F.col("ng_mask") != 0).select(*PIECE_COLUMNS)
