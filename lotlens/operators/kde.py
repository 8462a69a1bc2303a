"""Binned Gaussian KDE per (item, lot) and per (lot, frame, item).

A group's bins (60) or cells (288 at most) are one small array; binning, the
13-tap smoothing window and the normalisation are array functions on that row,
and the bins are exploded once at the end.  The detail is shuffled to make the
groups and for nothing else; a hot lot or item is combined map-side like any
other key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotlens.contracts import KDE_BANDWIDTH_BINS, KDE_BINS, check_item_names
from lotlens.functions.scalar import edge_bin, finite, gaussian_kernel, linspace_edge, spec_display_range
from lotlens.operators.densify import indexed_lots, item_lot_grid, present_items
from lotlens.operators.rows import judged_targets
from lotlens.plans.repository import lot_filter, stored_bins


def smoothed_bin(counts: Column, index: Column, sigma: float) -> Column:
    """Kernel-weighted count at bin ``index`` of an array of (bin, count); bins beyond the ends count nothing."""
    weights = gaussian_kernel(sigma)
    radius = len(weights) // 2
    taps = F.array(*[F.lit(w) for w in weights])
    return F.aggregate(counts, F.lit(0.0), lambda total, c: total + F.when(
        F.abs(c["bin"] - index) <= radius,
        c["count"].cast("double") * F.get(taps, (c["bin"] - index + radius).cast("int"))).otherwise(F.lit(0.0)))


def exploded_density(groups: DataFrame, keep: list[str], counts: str, lo: str, hi: str, bins: int,
                     sigma: float) -> DataFrame:
    """A row per group and bin: ``keep``, bin_index, x (bin centre) and density, all bins of a group at once.

    density = share of the group's smoothed total x coverage (in range /
    samples) / bin width; null where the group has no samples or its display range no width.
    """
    smooth = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda j: smoothed_bin(F.col(counts), j, sigma))
    rows = groups.withColumn("_smooth", smooth)
    rows = rows.withColumn("_total", F.aggregate("_smooth", F.lit(0.0), lambda a, x: a + x))
    # outer: from a plain explode Spark infers a filter that would compute the whole array once more
    rows = rows.select("*", F.posexplode_outer("_smooth").alias("bin_index", "_s"))
    low, high = F.col(lo), F.col(hi)
    share = F.when(F.col("_total") > 0, F.col("_s") / F.col("_total")).otherwise(F.lit(0.0))
    coverage = F.col("in_range_count").cast("double") / F.when(
        F.col("sample_count") > 0, F.col("sample_count").cast("double"))
    width = linspace_edge(low, high, F.lit(1), bins) - linspace_edge(low, high, F.lit(0), bins)
    return rows.select(*keep, "bin_index",
                       (linspace_edge(low, high, F.col("bin_index"), bins) + width / F.lit(2.0)).alias("x"),
                       (share * coverage / F.when(width != 0, width)).alias("density"))


def _lot_bins(bundle: dict, known: tuple[str, ...], lots, bins: int) -> DataFrame:
    """Dense (item, lot): sample and in-range counts and the stored bins as an array of at most ``bins``."""
    check_item_names(known)
    hist = stored_bins(bundle, bins, lots).filter(F.col("colname").isin(list(known)))
    inside = F.col("bin_index").isNotNull()
    counts = hist.groupBy("colname", "lot_number").agg(
        F.sum("count").cast("long").alias("sample_count"),
        F.sum(F.when(inside, F.col("count")).otherwise(F.lit(0))).cast("long").alias("in_range_count"),
        F.collect_list(F.when(inside, F.struct(F.col("bin_index").alias("bin"), F.col("count")))).alias("counts"))
    lots_idx = indexed_lots(lot_filter(bundle["lots"], lots))
    grid = item_lot_grid(lots_idx, present_items(hist, known), known)
    out = grid.join(counts, ["colname", "lot_number"], "left").fillna(0, ["sample_count", "in_range_count"])
    return out.withColumn("counts", F.coalesce("counts", F.array().cast("array<struct<bin:int,count:bigint>>")))


def kde_sample_counts(bundle: dict, known: tuple[str, ...], lots=None, bins: int = KDE_BINS) -> DataFrame:
    """Dense (item, lot): samples (incl. the out-of-range bin) and in-range samples."""
    return _lot_bins(bundle, known, lots, bins).select(
        "colname", "spec_order", "lot_number", "lot_start_time", "lot_index", "sample_count", "in_range_count")


def item_display(bundle: dict, known: tuple[str, ...], lots=None, bins: int = KDE_BINS) -> DataFrame:
    """Per item: display range and limits of its first histogram row (earliest lot,
    lowest bin, out of range last).  At most 63 rows, checked.  Order and
    fields are plain numbers, so this is a hash aggregate."""
    check_item_names(known)
    hist = stored_bins(bundle, bins, lots).filter(F.col("colname").isin(list(known)))
    order = (F.unix_micros(F.col("lot_start_time").cast("timestamp")) * 1024
             + F.coalesce(F.col("bin_index"), F.lit(bins)))
    return hist.groupBy("colname").agg(*[
        F.min_by(c, order).alias(c) for c in ("plot_min", "plot_max", "spec_lower", "spec_upper", "spec_best")])


def _lot_kde_parts(bundle: dict, known: tuple[str, ...], lots, bins: int, sigma: float):
    """(dense KDE, dense sample counts, per-item display) -- planned once, shared."""
    groups = _lot_bins(bundle, known, lots, bins)
    disp = item_display(bundle, known, lots, bins)
    ranged = groups.join(F.broadcast(disp.select("colname", "plot_min", "plot_max")), "colname", "inner")
    kde = exploded_density(ranged, ["colname", "spec_order", "lot_number", "lot_index", "sample_count", "in_range_count"],
                           "counts", "plot_min", "plot_max", bins, sigma)
    kde = kde.select("colname", "spec_order", "lot_number", "lot_index", "bin_index", "x", "density",
                     "sample_count", "in_range_count")
    return kde, groups, disp


def lot_kde(bundle: dict, known: tuple[str, ...], lots=None, bins: int = KDE_BINS,
            sigma: float = KDE_BANDWIDTH_BINS) -> DataFrame:
    """Dense (item, lot, bin): bin centre ``x`` and density.  The density
    integrates (sum x width) to in_range/samples of the (item, lot); an item
    absent from a lot has null density."""
    return _lot_kde_parts(bundle, known, lots, bins, sigma)[0]


def kde_context(bundle: dict, known: tuple[str, ...], lots=None, first_lot: int | None = None,
                visible: int = 8, bins: int = KDE_BINS, sigma: float = KDE_BANDWIDTH_BINS) -> DataFrame:
    """Per item: display range, lower/centre/upper/best, y max = max(1, 1.12 x
    peak density over all lots), and over the visible lot window the smallest
    sample count and the largest share outside the display range."""
    from lotlens.plans.views import lot_window
    kde, counts, disp = _lot_kde_parts(bundle, known, lots, bins, sigma)
    peak = kde.groupBy("colname").agg(F.max("density").alias("_peak"))
    win = lot_window(lot_filter(bundle["lots"], lots), first_lot, visible).select("lot_number")
    counts = counts.join(win, "lot_number", "left_semi")
    outside = F.lit(1.0) - F.col("in_range_count").cast("double") / F.when(
        F.col("sample_count") > 0, F.col("sample_count").cast("double"))
    vis = counts.groupBy("colname").agg(F.min("sample_count").alias("min_sample_count"),
                                        F.max(outside).alias("max_outside_rate"))
    lo, hi = F.col("spec_lower"), F.col("spec_upper")
    centre = F.when(finite(lo) & finite(hi), (lo + hi) / F.lit(2.0))
    return (disp.join(peak, "colname").join(vis, "colname", "left")
            .select("colname", "plot_min", "plot_max", "spec_lower", centre.alias("spec_center"),
                    "spec_upper", "spec_best",
                    F.greatest(F.lit(1.0), F.lit(1.12) * F.col("_peak")).alias("y_max"),
                    "min_sample_count", "max_outside_rate"))


# --- per frame -------------------------------------------------------------------
_CELL_FIELDS = ("value", "normalized_value", "ng_direction", "limmin", "limmax", "meta_best")


def frames(judged: DataFrame) -> DataFrame:
    """One row per (lot, frame, item): rows (incl. repeats), limits and best of the first cell in
    (Y, X) order, the smallest unit, and ``cells``, at most the 288 of a frame, in that order.

    A cell that was measured more than once counts as its first measurement by ``measure_id``; without that
    column such a cell is an error.  The detail moves once, to its frame; there its rows are one array.
    """
    t = judged_targets(judged)
    ordered = "measure_id" in t.columns
    order = [F.col("measure_id").isNull().alias("unnamed"), F.col("measure_id")] if ordered else []
    rows = t.groupBy("lot_number", "FrameNo", "colname").agg(
        F.array_sort(F.collect_list(F.struct("PositionY", "PositionX", *order, *_CELL_FIELDS))).alias("every"),
        F.array_min(F.collect_set("meta_unit")).alias("meta_unit"))

    def again(c: Column, i: Column) -> Column:
        before = F.get("every", i - 1)
        return (i > 0) & before["PositionY"].eqNullSafe(c["PositionY"]) & before["PositionX"].eqNullSafe(c["PositionX"])

    cells = F.filter("every", lambda c, i: ~again(c, i))
    if not ordered:  # nothing tells which of several measurements came first
        kind = rows.schema["every"].dataType
        cells = F.when(F.size(cells) == F.size("every"), F.col("every")).otherwise(
            F.raise_error(F.lit("a cell was measured twice and has no measure_id")).cast(kind))
    rows = rows.withColumn("cells", cells)
    first = F.col("cells")[0]
    return rows.select("lot_number", "FrameNo", "colname", F.size("every").cast("long").alias("row_count"),
                       first["limmin"].alias("spec_lower"), first["limmax"].alias("spec_upper"),
                       first["meta_best"].alias("spec_best"), "meta_unit", "cells")


def frame_kde(judged: DataFrame, bins: int = KDE_BINS, sigma: float = KDE_BANDWIDTH_BINS) -> DataFrame:
    """Dense (lot, frame, item, bin) KDE of the frames' cell values (of one frame: over its ``select_frame``).

    Range: from the frame's limits (two-sided, upper+best, lower+best) else
    the frame's own finite values padded by 4%; values binned against the
    explicit linspace edges (half-open bins, last bin closed).  Values are exploded to be binned and counted
    (plain columns, and no second shuffle: the rows stay where their frame is), then a frame's bins are one array.
    """
    rows = frames(judged).withColumn("values", F.filter(F.transform("cells", lambda c: c["value"]), finite))
    lo_l, hi_l, best = [F.when(finite(c), F.col(c)) for c in ("spec_lower", "spec_upper", "spec_best")]
    dmin, dmax = spec_display_range(lo_l, hi_l, best, F.array_min("values"), F.array_max("values"))
    rows = rows.withColumns({"display_min": dmin, "display_max": dmax, "sample_count": F.size("values").cast("long")})
    frame = ["lot_number", "FrameNo", "colname", "display_min", "display_max", "sample_count"]
    lo, hi, v = F.col("display_min"), F.col("display_max"), F.col("v")
    binned = rows.select(*frame, F.explode_outer("values").alias("v")).withColumn(
        "bin", F.when((v >= lo) & (v <= hi), edge_bin(v, lo, hi, bins)))
    counted = binned.groupBy(*frame, "bin").agg(F.count(F.lit(1)).alias("count"))
    rows = counted.groupBy(*frame).agg(
        F.collect_list(F.when(F.col("bin").isNotNull(), F.struct("bin", "count"))).alias("counts"),
        F.coalesce(F.sum(F.when(F.col("bin").isNotNull(), F.col("count"))), F.lit(0)).cast("long").alias("in_range_count"))
    out = exploded_density(rows, ["lot_number", "FrameNo", "colname", "sample_count", "in_range_count",
                                  "display_min", "display_max"], "counts", "display_min", "display_max", bins, sigma)
    return out.select("lot_number", "FrameNo", "colname", "bin_index", "x", "density", "sample_count",
                      "in_range_count", "display_min", "display_max")


def kde_y_max(kde: DataFrame, keys: list[str]) -> DataFrame:
    """Y-axis top of a KDE plot: max(1, 1.12 x the peak density over ``keys``)
    (per item for the lot form, per (lot, frame, item) for the frame form)."""
    return kde.groupBy(*keys).agg(
        F.greatest(F.lit(1.0), F.lit(1.12) * F.max("density")).alias("y_max"))
