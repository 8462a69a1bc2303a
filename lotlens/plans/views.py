"""Dashboard views over a bundle: dense matrices as long DataFrames.

``known`` is the item master order (bit / display order); views keep the
items that occur in the data (known ∩ present), as the viewer does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lotlens.contracts import FRAME_NUMBERS, VISIBLE_LOTS, ItemSpec, check_item_names
from lotlens.operators.levels import metric_levels
from lotlens.operators.densify import (indexed_lots, item_lot_grid, present_items, with_cells,
                                       with_frames)
from lotlens.plans.repository import lot_filter
from lotlens.sources.item_orders import CATEGORY_ORDER, VISION_ORDER


def item_attributes(frame_stats: DataFrame, known: tuple[str, ...]) -> DataFrame:
    """Per item: category, vision, limits and unit of its first row (earliest
    lot, lowest frame, lowest vision).  One row per known item (<= 63, checked).

    The order of rows is one number, so finding the smallest per item is a hash
    aggregate over the grain; the item's attributes are then those of the rows with it.
    """
    check_item_names(known)
    vision_no = F.coalesce(F.expr("try_cast(regexp_extract(vision, '([0-9]+)$', 1) AS INT)"), F.lit(0))
    order = F.unix_micros(F.col("lot_start_time").cast("timestamp")) * 64 + F.col("FrameNo") * 2
    rows = frame_stats.filter(F.col("colname").isin(list(known))).select(
        "colname", "meta_category", "vision", "spec_lower", "spec_upper", "spec_best", "meta_unit",
        order.alias("_order"), vision_no.alias("_vision"), "lot_number")
    first = rows.groupBy("colname").agg(F.min("_order").alias("_order"))
    ties = Window.partitionBy("colname").orderBy("_vision", "lot_number")
    return (rows.join(F.broadcast(first), ["colname", "_order"])
            .withColumn("_rank", F.row_number().over(ties)).filter("_rank = 1")
            .select("colname", "meta_category", "vision", "spec_lower", "spec_upper", "spec_best", "meta_unit"))


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """``df``, or a ValueError if it has no rows (runs a job)."""
    if df.isEmpty():
        raise ValueError(f"no {what} in the selection")
    return df


def _frame_grid(bundle: dict, known, lots, attributes: DataFrame):
    """Frame statistics of the selection and the dense grid of the items that ``attributes`` has."""
    stats = lot_filter(bundle["frame_item_stats"], lots).filter(F.col("colname").isin(list(known)))
    lots_idx = indexed_lots(lot_filter(bundle["lots"], lots))
    return stats, with_frames(item_lot_grid(lots_idx, attributes, known))


def _selected_attributes(bundle: dict, known, lots, category, vision) -> DataFrame:
    """Attributes of the items that occur in the selection and pass the filters."""
    attrs = item_attributes(lot_filter(bundle["frame_item_stats"], lots), known)
    if category is not None:
        attrs = attrs.filter(F.col("meta_category") == category)
    if vision is not None:
        attrs = attrs.filter(F.col("vision") == vision)
    return attrs


def column_position(lot_index, frame_no):
    """Linear FQ-map column: lot_index * 24 + frame - 1 (inverse: divmod by 24)."""
    return (lot_index * F.lit(len(FRAME_NUMBERS)) + frame_no - F.lit(1)).cast("int")


def column_to_lot_frame(column):
    """Inverse of ``column_position``: (lot_index, frame)."""
    n = F.lit(len(FRAME_NUMBERS))
    return (F.floor(column / n).cast("int"), (F.pmod(column, n) + 1).cast("int"))


def fq_map(bundle: dict, known: tuple[str, ...], lots=None, category: str | None = None,
           vision: str | None = None, required: bool = False) -> DataFrame:
    """item x (lot, frame) dense matrix: rates/means/stds null where a cell has
    no data, counts 0; ``selectable`` when the cell holds rows.  An empty
    selection has no rows, or raises ValueError if ``required``."""
    attrs = _selected_attributes(bundle, known, lots, category, vision).select("colname", "meta_category", "vision")
    stats, grid = _frame_grid(bundle, known, lots, require_rows(attrs, "items") if required else attrs)
    cells = stats.select("lot_number", "FrameNo", "colname", "ng_rate", "normalized_mean",
                         "normalized_std", "ng_count", "total_count")
    out = (grid.join(cells, ["colname", "lot_number", "FrameNo"], "left")
           .fillna(0, ["ng_count", "total_count"]))
    return out.select(
        "colname", "spec_order", "meta_category", "vision", "lot_number", "lot_start_time", "lot_index",
        "FrameNo", column_position(F.col("lot_index"), F.col("FrameNo")).alias("column"),
        "ng_rate", "normalized_mean", "normalized_std", "ng_count", "total_count",
        (F.col("total_count") > 0).alias("selectable"))


def filter_options(bundle: dict, known: tuple[str, ...], lots=None) -> DataFrame:
    """Distinct categories and visions on offer (kind, value, first item order), in the
    domain's display order; values it does not name follow by their first item."""
    stats = lot_filter(bundle["frame_item_stats"], lots)
    attrs = item_attributes(stats, known)
    order = F.create_map(*[x for i, c in enumerate(known) for x in (F.lit(c), F.lit(i))])
    ranked = attrs.withColumn("o", F.try_element_at(order, F.col("colname")))
    cat = ranked.groupBy("meta_category").agg(F.min("o").alias("first_order")).select(
        F.lit("category").alias("kind"), F.col("meta_category").alias("value"), "first_order")
    vis = ranked.groupBy("vision").agg(F.min("o").alias("first_order")).select(
        F.lit("vision").alias("kind"), F.col("vision").alias("value"), "first_order")
    named = F.array(*[F.lit(v) for v in (*CATEGORY_ORDER, *VISION_ORDER)])
    place = F.array_position(named, F.col("value"))
    return cat.unionByName(vis).orderBy("kind", F.when(place > 0, place).asc_nulls_last(), "first_order")


def frame_map(bundle: dict, known: tuple[str, ...], lots=None) -> DataFrame:
    """item x lot x Y x X dense: NG rate, normalised mean and std per cell."""
    stats = lot_filter(bundle["position_item_stats"], lots).filter(F.col("colname").isin(list(known)))
    lots_idx = indexed_lots(lot_filter(bundle["lots"], lots))
    grid = with_cells(item_lot_grid(lots_idx, present_items(stats, known), known))
    cells = stats.select("colname", "lot_number", "PositionY", "PositionX", "ng_rate", "normalized_mean",
                         "normalized_std")
    out = grid.join(cells, ["colname", "lot_number", "PositionY", "PositionX"], "left")
    return out.select("colname", "spec_order", "lot_number", "lot_index", "PositionY", "PositionX",
                      "ng_rate", "normalized_mean", "normalized_std")


QUANTILE_FIELDS = ("minimum", "p05", "p25", "p50", "p75", "p95", "maximum")


def quality_trend(bundle: dict, known: tuple[str, ...], lots=None) -> DataFrame:
    """item x (lot, frame) dense: N and NG (0 where missing), min/quantiles/max
    (null where missing), item limits and unit from the item's first row."""
    attrs = _selected_attributes(bundle, known, lots, None, None).select(
        "colname", "spec_lower", "spec_upper", "meta_unit")
    stats, grid = _frame_grid(bundle, known, lots, attrs)
    cells = stats.select("colname", "lot_number", "FrameNo", "sample_count", "ng_count", *QUANTILE_FIELDS)
    out = (grid.join(cells, ["colname", "lot_number", "FrameNo"], "left")
           .fillna(0, ["sample_count", "ng_count"]))
    return out.select("colname", "spec_order", "lot_number", "lot_index", "FrameNo",
                      column_position(F.col("lot_index"), F.col("FrameNo")).alias("column"),
                      "sample_count", "ng_count", *QUANTILE_FIELDS, "spec_lower", "spec_upper", "meta_unit")


def cell_detail(bundle: dict, lot: str | None = None, frame: int | None = None,
                colname: str | None = None) -> DataFrame:
    """What a cell click shows: rate with counts, mean deviation, std and the
    quantile summary with N and NG, for one cell or (keys omitted) all cells."""
    df = bundle["frame_item_stats"]
    if lot is not None:
        df = df.filter(F.col("lot_number") == lot)
    if frame is not None:
        df = df.filter(F.col("FrameNo") == frame)
    if colname is not None:
        df = df.filter(F.col("colname") == colname)
    return df.select("lot_number", "FrameNo", "colname", "ng_rate", "ng_count", "total_count",
                     "normalized_mean", "normalized_std", "sample_count", *QUANTILE_FIELDS)


def lot_window(lots_df: DataFrame, first_lot: int | None = None, visible: int = VISIBLE_LOTS) -> DataFrame:
    """``visible`` consecutive lots by start time from ``first_lot`` (0-based);
    default: the last ``visible`` lots.  Runs over the lots dimension only."""
    idx = indexed_lots(lots_df)
    if first_lot is None:
        total = lots_df.agg(F.count(F.lit(1))).scalar()
        start = F.greatest(F.lit(0).cast("long"), total - F.lit(visible))
    else:
        start = F.lit(int(first_lot)).cast("long")
    return idx.filter((F.col("lot_index") >= start) & (F.col("lot_index") < start + F.lit(visible)))


def _selected_items(items: tuple[ItemSpec, ...], category, vision) -> list[ItemSpec]:
    return [i for i in items
            if (category is None or i.meta_category == category) and (vision is None or i.vision == vision)]


def selected_cells(bundle: dict, known: tuple[str, ...], lots=None, category=None,
                   vision=None) -> DataFrame:
    """Frame-grain cells of the selected lots and of the known items passing the
    category / vision filter -- the non-empty cells of ``fq_map`` without
    building its dense grid (sums and percentiles ignore empty cells anyway)."""
    stats = lot_filter(bundle["frame_item_stats"], lots).filter(F.col("colname").isin(list(known)))
    if category is None and vision is None:
        return stats
    attrs = _selected_attributes(bundle, known, lots, category, vision)
    return stats.join(F.broadcast(attrs.select("colname")), "colname", "left_semi")


def totals(bundle: dict, known: tuple[str, ...], lots=None, category=None, vision=None) -> DataFrame:
    """Total NG, measurements and item count over the current item selection."""
    fq = selected_cells(bundle, known, lots, category, vision)
    return fq.agg(F.sum("ng_count").cast("long").alias("total_ng"),
                  F.sum("total_count").cast("long").alias("total_measurements"),
                  F.count_distinct("colname").alias("item_count"))


def piece_yield(bundle: dict, items: tuple[ItemSpec, ...], lots=None, category=None,
                vision=None) -> DataFrame:
    """NG pieces = pieces whose mask hits any selected item's bit; the
    denominator is every piece of the selected lots, whatever the item filter.
    Without pieces the yield is null."""
    index = {c: i for i, c in enumerate(bundle["bit_items"])}
    bits = 0
    for it in _selected_items(items, category, vision):
        if it.colname in index:
            bits |= 1 << index[it.colname]
    p = lot_filter(bundle["piece_ng"], lots)
    hit = F.col("ng_mask").bitwiseAND(F.lit(bits).cast("long")) != 0
    agg = p.agg(F.count(F.lit(1)).alias("total_pieces"), F.count_if(hit).alias("ng_pieces"))
    return agg.select(
        "total_pieces", "ng_pieces", (F.col("total_pieces") - F.col("ng_pieces")).alias("ok_pieces"),
        F.try_divide(F.lit(100.0) * (F.col("total_pieces") - F.col("ng_pieces")), F.col("total_pieces"))
        .alias("piece_yield"))


def dashboard_summary(bundle: dict, items: tuple[ItemSpec, ...], lots=None, category=None,
                      vision=None) -> DataFrame:
    """One row: lots (all selected ones, whatever the item filter), items, measurements, NG,
    pieces, OK pieces, yield and the three FQ colour maxima (exact 99.5th
    percentile of the selected cells, rounded up by ``nice_upper``).  The
    1-row aggregates are stacked with a union and folded by one aggregate (no join).
    An empty selection has counts 0 and null yield and maxima."""
    known = tuple(i.colname for i in items)
    fq = selected_cells(bundle, known, lots, category, vision)
    cells = fq.agg(
        F.count_distinct("colname").alias("item_count"),
        F.coalesce(F.sum("total_count"), F.lit(0)).cast("long").alias("total_measurements"),
        F.coalesce(F.sum("ng_count"), F.lit(0)).cast("long").alias("total_ng"),
    )
    lot_count = lot_filter(bundle["lots"], lots).agg(F.count(F.lit(1)).alias("lot_count"))
    levels = metric_levels(fq, [], few_groups=True).select(F.col("ng_rate_max"), F.col("normalized_mean_max").alias("deviation_max"),
                                          F.col("normalized_std_max").alias("std_max"))
    pieces = piece_yield(bundle, items, lots, category, vision)
    n_cols, c_cols = ["lot_count"], ["item_count", "total_measurements", "total_ng"]
    l_cols = ["ng_rate_max", "deviation_max", "std_max"]
    p_cols = ["total_pieces", "ng_pieces", "ok_pieces", "piece_yield"]
    dtype = {c: "long" for c in n_cols + c_cols + p_cols} | {c: "double" for c in l_cols + ["piece_yield"]}

    def padded(df, own):
        return df.select(*[F.col(c) if c in own else F.lit(None).cast(dtype[c]).alias(c)
                           for c in n_cols + c_cols + l_cols + p_cols])
    one = (padded(lot_count, n_cols).unionByName(padded(cells, c_cols)).unionByName(padded(levels, l_cols)).unionByName(padded(pieces, p_cols))
           .agg(*[F.max(c).alias(c) for c in n_cols + c_cols + l_cols + p_cols]))
    return one.select("lot_count", "item_count", "total_measurements", "total_ng", "total_pieces", "ok_pieces",
                      "piece_yield", *l_cols)
