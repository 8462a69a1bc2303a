"""Named read queries over an analysis bundle (in memory or opened from disk).

A *bundle* is a mapping ``{"lots", "frame_item_stats", "position_item_stats",
"lot_item_histogram", "piece_ng"} -> DataFrame`` (``open_bundle`` returns
one; ``bundle_from_judged`` builds one lazily).  Every reader takes an
optional lot selection: a list of names (``None`` and an empty list both mean all
lots) or a table of lots.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotlens.contracts import KDE_BINS
from lotlens.operators import aggregates as A
from lotlens.operators.rows import judged_targets
from lotlens.sources.stages import START_DATE, select_frame


class LazyBundle(dict):
    """Bundle whose grains are built on first access (a view that reads one
    grain never plans the other four)."""

    def __init__(self, builders: dict, **meta):
        super().__init__(**meta)
        self._builders = builders

    def __missing__(self, key):
        if key not in self._builders:
            raise KeyError(key)
        value = self._builders[key]()
        self[key] = value
        return value


def bundle_from_judged(judged: DataFrame, bit_items, bins: int = KDE_BINS) -> dict:
    """The five grains as lazy DataFrames (nothing is planned until used)."""
    return LazyBundle({
        "lots": lambda: A.lots(judged),
        "frame_item_stats": lambda: A.frame_item_stats(judged),
        "position_item_stats": lambda: A.position_item_stats(judged),
        "lot_item_histogram": lambda: A.lot_item_histogram(judged, bins),
        "piece_ng": lambda: A.piece_ng(judged, bit_items),
    }, bit_items=tuple(bit_items), kde_bins=bins)


def lot_filter(df: DataFrame, lots=None) -> DataFrame:
    """Rows of the chosen lots: a list of names, or a table with ``lot_number`` (such as a filtered lots table).

    A list becomes a literal filter that prunes files; ``None`` or an empty one means every lot.  A table
    selects by semi-join and is never collected (an empty table selects nothing).  If both sides have
    ``start_date``, it joins too, and Spark prunes the stage's folders by the lots' dates at run time.
    """
    if isinstance(lots, DataFrame):
        keys = ["lot_number", *([START_DATE] if START_DATE in df.columns and START_DATE in lots.columns else [])]
        return df.join(lots.select(*keys), keys, "left_semi")
    if not lots:
        return df
    return df.filter(F.col("lot_number").isin(list(lots)))


def lots(bundle: dict) -> DataFrame:
    """Lots in start-time order (one row per lot: a small sort)."""
    return bundle["lots"].select("lot_number", "lot_start_time").orderBy("lot_start_time", "lot_number")


def _in_order(df: DataFrame, *then: str) -> DataFrame:
    """Rows by lot start, lot and ``then``; nulls last.  (Spark drops the sort where a later step ignores it.)"""
    return df.orderBy(*[F.col(c).asc_nulls_last() for c in ("lot_start_time", "lot_number", *then)])


def ng_rate_by_frame(bundle: dict, lots=None) -> DataFrame:
    return _in_order(lot_filter(bundle["frame_item_stats"], lots), "FrameNo", "colname").select(
        "lot_number", "FrameNo", "vision", "colname", "meta_category", "total_count", "ng_count",
        "ng_rate", "normalized_mean", "normalized_std")


def quantiles_by_frame(bundle: dict, lots=None) -> DataFrame:
    return _in_order(lot_filter(bundle["frame_item_stats"], lots), "FrameNo", "colname").select(
        "lot_number", "FrameNo", "colname", "sample_count", "ng_count", "minimum", "p05", "p25",
        "p50", "p75", "p95", "maximum", "spec_lower", "spec_upper", "meta_unit")


def metrics_by_position(bundle: dict, lots=None) -> DataFrame:
    return _in_order(lot_filter(bundle["position_item_stats"], lots), "colname", "PositionY", "PositionX").select(
        "lot_number", "colname", "PositionX", "PositionY", "total_count", "ng_count", "ng_rate",
        "normalized_mean", "normalized_std")


def kde_bins(bundle: dict, bins: int, lots=None) -> DataFrame:
    return _in_order(stored_bins(bundle, bins, lots), "colname", "bin_index").select(
        "lot_number", "colname", "bin_index", "plot_min", "plot_max", "spec_lower", "spec_upper",
        "spec_best", "count")


def stored_bins(bundle: dict, bins: int, lots=None) -> DataFrame:
    """The histogram of the selected lots, in any order; the requested bins must be the stored ones."""
    if bundle.get("kde_bins", bins) != bins:
        raise ValueError(f"KDE bin mismatch: data={bundle.get('kde_bins')}, requested={bins}")
    return lot_filter(bundle["lot_item_histogram"], lots)


def remap_mask(mask: Column, bit_items, colnames) -> Column:
    """Re-express a stored NG mask in the bit order of ``colnames``
    (bit k = ``colnames[k]``).  Unknown names raise, as a lookup would."""
    index = {c: i for i, c in enumerate(bit_items)}
    missing = [c for c in colnames if c not in index]
    if missing:
        raise KeyError(f"items not in the bit map: {missing}")
    if tuple(colnames) == tuple(bit_items):
        return mask
    parts = [F.when(mask.bitwiseAND(F.lit(1 << index[c])) != 0, F.lit(1 << k)).otherwise(F.lit(0))
             for k, c in enumerate(colnames)]
    return reduce(lambda a, b: a.bitwiseOR(b), parts, F.lit(0).cast("long")).cast("long")


def piece_masks(bundle: dict, colnames, lots=None) -> DataFrame:
    """Per piece the NG mask in the bit order of ``colnames``."""
    p = _in_order(lot_filter(bundle["piece_ng"], lots), "FrameNo", "PositionY", "PositionX")
    return p.select("lot_number", "lot_start_time", "FrameNo", "PositionX", "PositionY",
                    remap_mask(F.col("ng_mask"), bundle["bit_items"], colnames).alias("ng_mask"))


FRAME_VALUE_COLUMNS = ("PositionX", "PositionY", "value", "normalized_value", "is_ng", "ng_direction",
                       "limmin", "limmax", "meta_best", "meta_unit")


def frame_values(judged: DataFrame, lot: str | None = None, frame: int | None = None,
                 colname: str | None = None, days: DataFrame | None = None) -> DataFrame:
    """Judged detail of one (lot, frame, item) -- or of all of them when the
    keys are omitted (batch form).  A point lookup on a stage read with ``dated``, given the
    stage's ``lot_days``, reads the lot's folder only; the rest is pushed down."""
    df = select_frame(judged_targets(judged), lot, frame, colname, days)
    out = df.select("lot_number", "FrameNo", "colname", *FRAME_VALUE_COLUMNS)
    if lot is not None and frame is not None and colname is not None:
        out = out.orderBy("PositionY", "PositionX")      # one frame: at most a few hundred rows
    return out
