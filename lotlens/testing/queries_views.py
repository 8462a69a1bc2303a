"""Registered queries: repository reads, dense views, KDE, levels, frames, paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from lotlens.operators import aggregates as A
from lotlens.operators import frames as FR
from lotlens.operators import kde as K
from lotlens.operators import levels as L
from lotlens.operators.densify import indexed_lots
from lotlens.plans import repository as R
from lotlens.plans import views as V
from lotlens.sources.fixtures import EVENT_ITEMS
from lotlens.sources.paths import path_catalog
from lotlens.sources.stages import lot_days, read_stage
from lotlens.testing.queries_core import (
    BIT_ITEMS, FRAME_STATS_SQL, PIECE_SQL, POSITION_STATS_SQL, histogram_ctes, judged_events, written_judged)
from lotlens.testing.registry import register

KNOWN = BIT_ITEMS
TARGET_ITEMS = tuple(i.colname for i in EVENT_ITEMS if i.meta_type == "spec" and not i.meta_ignore)
BINS = 60


def bundle(spark, sf_dir):
    return R.bundle_from_judged(judged_events(spark, sf_dir), BIT_ITEMS, BINS)


# --- shared oracle CTEs -------------------------------------------------------------
def _values(rows) -> str:
    return ", ".join(rows)


KNOWN_CTE = "known(colname, spec_order) AS (VALUES " + _values(
    f"('{c}', {i})" for i, c in enumerate(KNOWN)) + ")"
# Gaussian weights over +-4 sigma (sigma 1.5 bins: 6 bins), computed by the oracle itself.
KERNEL_CTE = """taps AS (SELECT k AS k_offset, exp(-(k * k) / (2 * 1.5::DOUBLE * 1.5::DOUBLE)) AS raw_weight
  FROM (SELECT CAST(range AS INTEGER) AS k FROM range(-6, 7))),
kernel AS (SELECT k_offset, raw_weight / sum(raw_weight) OVER () AS k_weight FROM taps)"""

BASE = f"""
fstats AS ({FRAME_STATS_SQL}),
pstats AS ({POSITION_STATS_SQL}),
{histogram_ctes(BINS)},
lotsx AS (SELECT lot_number, min(lot_start_time) AS lot_start_time FROM judged GROUP BY lot_number),
lot_idx AS (SELECT *, CAST(row_number() OVER (ORDER BY lot_start_time, lot_number) - 1 AS INTEGER) AS lot_index
            FROM lotsx),
{KNOWN_CTE},
{KERNEL_CTE},
frames(FrameNo) AS (SELECT CAST(range AS SMALLINT) FROM range(1, 25)),
ys(PositionY) AS (SELECT CAST(range AS TINYINT) FROM range(1, 13)),
xs(PositionX) AS (SELECT CAST(range AS TINYINT) FROM range(1, 25)),
bins_t(bin_index) AS (SELECT CAST(range AS INTEGER) FROM range(0, {BINS})),
attrs AS (
  SELECT colname,
    first(meta_category ORDER BY lot_start_time, FrameNo, vision) AS meta_category,
    first(vision ORDER BY lot_start_time, FrameNo, vision) AS vision,
    first(spec_lower ORDER BY lot_start_time, FrameNo, vision) AS spec_lower,
    first(spec_upper ORDER BY lot_start_time, FrameNo, vision) AS spec_upper,
    first(meta_unit ORDER BY lot_start_time, FrameNo, vision) AS meta_unit
  FROM fstats WHERE colname IN (SELECT colname FROM known) GROUP BY colname
),
grid_f AS (
  SELECT l.lot_number, l.lot_start_time, l.lot_index, k.colname, k.spec_order, f.FrameNo
  FROM lot_idx l, known k, frames f
  WHERE k.colname IN (SELECT colname FROM fstats)
),
fq AS (
  SELECT g.colname, g.spec_order, a.meta_category, a.vision, g.lot_number, g.lot_start_time, g.lot_index,
    g.FrameNo, CAST(g.lot_index * 24 + g.FrameNo - 1 AS INTEGER) AS "column",
    s.ng_rate, s.normalized_mean, s.normalized_std,
    coalesce(s.ng_count, 0) AS ng_count, coalesce(s.total_count, 0) AS total_count,
    coalesce(s.total_count, 0) > 0 AS selectable
  FROM grid_f g JOIN attrs a ON a.colname = g.colname
  LEFT JOIN fstats s ON s.colname = g.colname AND s.lot_number = g.lot_number AND s.FrameNo = g.FrameNo
),
fmap AS (
  SELECT k.colname, k.spec_order, l.lot_number, l.lot_index, y.PositionY, x.PositionX,
    s.ng_rate, s.normalized_mean, s.normalized_std
  FROM lot_idx l CROSS JOIN known k CROSS JOIN ys y CROSS JOIN xs x
  LEFT JOIN pstats s ON s.colname = k.colname AND s.lot_number = l.lot_number
    AND s.PositionY = y.PositionY AND s.PositionX = x.PositionX
  WHERE k.colname IN (SELECT colname FROM pstats)
),
trend AS (
  SELECT g.colname, g.spec_order, g.lot_number, g.lot_index, g.FrameNo,
    CAST(g.lot_index * 24 + g.FrameNo - 1 AS INTEGER) AS "column",
    coalesce(s.sample_count, 0) AS sample_count, coalesce(s.ng_count, 0) AS ng_count,
    s.minimum, s.p05, s.p25, s.p50, s.p75, s.p95, s.maximum, a.spec_lower, a.spec_upper, a.meta_unit
  FROM grid_f g
  LEFT JOIN fstats s ON s.colname = g.colname AND s.lot_number = g.lot_number AND s.FrameNo = g.FrameNo
  LEFT JOIN attrs a ON a.colname = g.colname
)"""


def nice_upper_sql(x: str, minimum: float) -> str:
    mag = f"pow(10.0::DOUBLE, floor(log10({x})))"
    n = f"({x} / {mag})"
    steps = " ".join(f"WHEN {n} <= {s!r}::DOUBLE THEN {s!r}::DOUBLE * {mag}" for s in (1.0, 2.0, 3.0, 5.0, 10.0))
    return (f"CASE WHEN {x} IS NULL OR isnan({x}) THEN NULL WHEN {x} <= 0 THEN {minimum!r}::DOUBLE "
            f"ELSE greatest({minimum!r}::DOUBLE, CASE {steps} ELSE {x} END) END")


def reg(key, body, doubles=(), extra=""):
    ctes = BASE + (",\n" + extra.strip() if extra.strip() else "")
    return register(key, body, list(doubles), extra_ctes=ctes)


# --- repository reads (VW1-VW4, FLT2, FLT3) ----------------------------------------
@reg("ng_rate_by_frame", "SELECT lot_number, FrameNo, vision, colname, meta_category, total_count, ng_count, "
     "ng_rate, normalized_mean, normalized_std FROM fstats", ["ng_rate", "normalized_mean", "normalized_std"])
def ng_rate_by_frame_q(spark, sf_dir):
    """VW1."""
    return R.ng_rate_by_frame(bundle(spark, sf_dir))


@reg("lot_filter", "SELECT lot_number, FrameNo, vision, colname, meta_category, total_count, ng_count, "
     "ng_rate, normalized_mean, normalized_std FROM fstats WHERE lot_number IN "
     "(SELECT lot_number FROM lot_idx WHERE lot_index % 3 = 1)", ["ng_rate", "normalized_mean", "normalized_std"])
def lot_filter_q(spark, sf_dir):
    """FLT2: every third lot, picked from the lots table as a table."""
    b = bundle(spark, sf_dir)
    return R.ng_rate_by_frame(b, lots=indexed_lots(b["lots"]).filter("lot_index % 3 = 1"))


@reg("stage_lots", "SELECT measure_id, lot_number, FrameNo, colname, value, ng_direction FROM judged WHERE lot_number IN "
     "(SELECT lot_number FROM lot_idx WHERE lot_index % 3 = 1)", ["value"])
def stage_lots_q(spark, sf_dir):
    """FLT2 on a written stage: every third lot, given as a table with its start dates, which prune the stage's folders."""
    path = written_judged(spark, sf_dir)
    judged = read_stage(spark, path, "judged", dated=True)
    picked = indexed_lots(A.lots(judged)).filter("lot_index % 3 = 1").select("lot_number")
    days = R.lot_filter(lot_days(spark, path), picked)
    return R.lot_filter(judged, days).select("measure_id", "lot_number", "FrameNo", "colname", "value", "ng_direction")


_Q_DOUBLES = ["minimum", "p05", "p25", "p50", "p75", "p95", "maximum", "spec_lower", "spec_upper"]


@reg("quantiles_by_frame", "SELECT lot_number, FrameNo, colname, sample_count, ng_count, minimum, p05, p25, "
     "p50, p75, p95, maximum, spec_lower, spec_upper, meta_unit FROM fstats", _Q_DOUBLES)
def quantiles_by_frame_q(spark, sf_dir):
    """VW2."""
    return R.quantiles_by_frame(bundle(spark, sf_dir))


@reg("metrics_by_position", "SELECT lot_number, colname, PositionX, PositionY, total_count, ng_count, ng_rate, "
     "normalized_mean, normalized_std FROM pstats", ["ng_rate", "normalized_mean", "normalized_std"])
def metrics_by_position_q(spark, sf_dir):
    """VW3."""
    return R.metrics_by_position(bundle(spark, sf_dir))


@reg("kde_bins", "SELECT lot_number, colname, CAST(bin_index AS DOUBLE) AS bin_index, plot_min, plot_max, "
     "spec_lower, spec_upper, spec_best, \"count\" FROM histogram",
     ["bin_index", "plot_min", "plot_max", "spec_lower", "spec_upper", "spec_best"])
def kde_bins_q(spark, sf_dir):
    """VW4 (bin index compared as double: the out-of-range bin is null)."""
    return R.kde_bins(bundle(spark, sf_dir), BINS).withColumn("bin_index", F.col("bin_index").cast("double"))


@reg("frame_values", "SELECT lot_number, FrameNo, colname, PositionX, PositionY, value, normalized_value, "
     "is_ng, ng_direction, limmin, limmax, meta_best, meta_unit FROM targets",
     ["value", "normalized_value", "limmin", "limmax", "meta_best"])
def frame_values_q(spark, sf_dir):
    """FLT3 in batch form: the judged detail of every (lot, frame, item)."""
    return R.frame_values(judged_events(spark, sf_dir))


def _remap_sql() -> str:
    index = {c: i for i, c in enumerate(BIT_ITEMS)}
    parts = " | ".join(f"(CASE WHEN (ng_mask & CAST({1 << index[c]} AS BIGINT)) <> 0 THEN CAST({1 << k} AS BIGINT)"
                       f" ELSE CAST(0 AS BIGINT) END)" for k, c in enumerate(TARGET_ITEMS))
    return parts


@reg("piece_masks", f"""
SELECT lot_number, lot_start_time, FrameNo, PositionX, PositionY, CAST({_remap_sql()} AS BIGINT) AS ng_mask
FROM pieces""", extra=f"pieces AS ({PIECE_SQL})")
def piece_masks_q(spark, sf_dir):
    """Stored masks re-expressed in the bit order of the target items."""
    return R.piece_masks(bundle(spark, sf_dir), TARGET_ITEMS)


# --- dense views --------------------------------------------------------------------
_FQ_DOUBLES = ["ng_rate", "normalized_mean", "normalized_std"]


@reg("fq_map", "SELECT * FROM fq", _FQ_DOUBLES)
def fq_map_q(spark, sf_dir):
    """VW5 + JN2/JN4/JN5/JN6 + WN4 + FLT7."""
    return V.fq_map(bundle(spark, sf_dir), KNOWN)


@reg("filter_rows", "SELECT * FROM fq WHERE meta_category = 'error'", _FQ_DOUBLES)
def filter_rows_q(spark, sf_dir):
    """FLT4: item rows of one category."""
    return V.fq_map(bundle(spark, sf_dir), KNOWN, category="error")


@reg("filter_vision", "SELECT * FROM fq WHERE vision = 'vision_2'", _FQ_DOUBLES)
def filter_vision_q(spark, sf_dir):
    """FLT4: item rows of one vision."""
    return V.fq_map(bundle(spark, sf_dir), KNOWN, vision="vision_2")


@reg("densify", "SELECT colname, count(*) AS cells, CAST(count_if(selectable) AS BIGINT) AS cells_with_data "
     "FROM fq GROUP BY colname")
def densify_q(spark, sf_dir):
    """JN2: dense cells vs cells holding data, per item."""
    fq = V.fq_map(bundle(spark, sf_dir), KNOWN)
    return fq.groupBy("colname").agg(F.count(F.lit(1)).alias("cells"),
                                     F.count_if("selectable").alias("cells_with_data"))


@reg("column_position", "SELECT DISTINCT lot_number, lot_index, FrameNo, \"column\", "
     "CAST(floor(\"column\" / 24) AS INTEGER) AS lot_index_back, CAST(\"column\" % 24 + 1 AS INTEGER) AS frame_back "
     "FROM fq")
def column_position_q(spark, sf_dir):
    """WN4: column = lot_index * 24 + frame - 1 and its inverse."""
    fq = V.fq_map(bundle(spark, sf_dir), KNOWN)
    back_lot, back_frame = V.column_to_lot_frame(F.col("column"))
    return fq.select("lot_number", "lot_index", "FrameNo", "column", back_lot.alias("lot_index_back"),
                     back_frame.alias("frame_back")).distinct()


@reg("item_lookup", "SELECT colname, meta_category, vision, spec_lower, spec_upper, meta_unit FROM attrs",
     ["spec_lower", "spec_upper"])
def item_lookup_q(spark, sf_dir):
    """JN5: item -> category, vision, limits, unit of its first row."""
    return V.item_attributes(bundle(spark, sf_dir)["frame_item_stats"], KNOWN).drop("spec_best")


@reg("filter_options", """
SELECT 'category' AS kind, meta_category AS value, min(k.spec_order) AS first_order
FROM attrs a JOIN known k USING (colname) GROUP BY meta_category
UNION ALL
SELECT 'vision', vision, min(k.spec_order) FROM attrs a JOIN known k USING (colname) GROUP BY vision""")
def filter_options_q(spark, sf_dir):
    """Categories and visions on offer, with the order of their first item."""
    return V.filter_options(bundle(spark, sf_dir), KNOWN)


@reg("frame_map", "SELECT * FROM fmap", _FQ_DOUBLES)
def frame_map_q(spark, sf_dir):
    """VW6: item x lot x Y x X dense position map."""
    return V.frame_map(bundle(spark, sf_dir), KNOWN)


_TREND_DOUBLES = ["minimum", "p05", "p25", "p50", "p75", "p95", "maximum", "spec_lower", "spec_upper"]


@reg("quality_trend", "SELECT * FROM trend", _TREND_DOUBLES)
def quality_trend_q(spark, sf_dir):
    """VW9: item x (lot, frame) dense quantile trend."""
    return V.quality_trend(bundle(spark, sf_dir), KNOWN)


@reg("cell_detail", "SELECT lot_number, FrameNo, colname, ng_rate, ng_count, total_count, normalized_mean, "
     "normalized_std, sample_count, minimum, p05, p25, p50, p75, p95, maximum FROM fstats",
     ["ng_rate", "normalized_mean", "normalized_std", "minimum", "p05", "p25", "p50", "p75", "p95", "maximum"])
def cell_detail_q(spark, sf_dir):
    """FLT6 (all cells at once)."""
    return V.cell_detail(bundle(spark, sf_dir))


@reg("lot_window", "SELECT lot_number, lot_start_time, lot_index FROM lot_idx "
     "WHERE lot_index >= greatest(0, (SELECT count(*) FROM lot_idx) - 8)")
def lot_window_q(spark, sf_dir):
    """FLT5: default window = the last 8 lots by start time."""
    return V.lot_window(bundle(spark, sf_dir)["lots"])


@reg("lot_window_from", "SELECT lot_number, lot_start_time, lot_index FROM lot_idx WHERE lot_index BETWEEN 2 AND 6")
def lot_window_from_q(spark, sf_dir):
    """FLT5 from a given first lot: five lots from the third on."""
    return V.lot_window(bundle(spark, sf_dir)["lots"], first_lot=2, visible=5)


@reg("totals_vision", "SELECT CAST(sum(ng_count) AS BIGINT) AS total_ng, CAST(sum(total_count) AS BIGINT) "
     "AS total_measurements, count(DISTINCT colname) AS item_count FROM fq WHERE vision = 'vision_3'")
def totals_vision_q(spark, sf_dir):
    """AG8 over the items of one vision."""
    return V.totals(bundle(spark, sf_dir), KNOWN, vision="vision_3")


@reg("totals", "SELECT CAST(sum(ng_count) AS BIGINT) AS total_ng, CAST(sum(total_count) AS BIGINT) "
     "AS total_measurements, count(DISTINCT colname) AS item_count FROM fq")
def totals_q(spark, sf_dir):
    """AG8."""
    return V.totals(bundle(spark, sf_dir), KNOWN)


def _bits(category=None):
    b = 0
    for i, it in enumerate(EVENT_ITEMS):
        if category is None or it.meta_category == category:
            b |= 1 << i
    return b


def _yield_sql(category=None) -> str:
    hit = f"(ng_mask & CAST({_bits(category)} AS BIGINT)) <> 0"
    return (f"SELECT count(*) AS total_pieces, CAST(count_if({hit}) AS BIGINT) AS ng_pieces, "
            f"count(*) - CAST(count_if({hit}) AS BIGINT) AS ok_pieces, "
            f"100.0::DOUBLE * (count(*) - count_if({hit})) / count(*) AS piece_yield FROM pieces")


_PIECES = f"pieces AS ({PIECE_SQL})"


@reg("piece_yield", _yield_sql(), ["piece_yield"], extra=_PIECES)
def piece_yield_q(spark, sf_dir):
    """AG9 over all items."""
    return V.piece_yield(bundle(spark, sf_dir), EVENT_ITEMS)


@reg("piece_yield_category", _yield_sql("click"), ["piece_yield"], extra=_PIECES)
def piece_yield_category_q(spark, sf_dir):
    """AG9 for one category: NG bits of that category, all pieces as denominator."""
    return V.piece_yield(bundle(spark, sf_dir), EVENT_ITEMS, category="click")


def _dashboard_sql(category=None) -> str:
    chosen = "" if category is None else f" WHERE meta_category = '{category}'"
    return f"""
SELECT (SELECT count(*) FROM lot_idx) AS lot_count, c.item_count, c.total_measurements, c.total_ng,
  p.total_pieces, p.ok_pieces, p.piece_yield,
  {nice_upper_sql('c.ng_p', 1.0)} AS ng_rate_max,
  {nice_upper_sql('c.mean_p', 0.1)} AS deviation_max,
  {nice_upper_sql('c.std_p', 0.1)} AS std_max
FROM (SELECT count(DISTINCT colname) AS item_count,
        CAST(sum(total_count) AS BIGINT) AS total_measurements, CAST(sum(ng_count) AS BIGINT) AS total_ng,
        quantile_cont(ng_rate, 0.995) AS ng_p, quantile_cont(normalized_mean, 0.995) AS mean_p,
        quantile_cont(normalized_std, 0.995) AS std_p FROM fq{chosen}) c,
     ({_yield_sql(category)}) p"""


_DASHBOARD_DOUBLES = ["piece_yield", "ng_rate_max", "deviation_max", "std_max"]


@reg("dashboard_summary", _dashboard_sql(), _DASHBOARD_DOUBLES, extra=_PIECES)
def dashboard_summary_q(spark, sf_dir):
    """VW14 + AG12 (FQ form)."""
    return V.dashboard_summary(bundle(spark, sf_dir), EVENT_ITEMS)


@reg("dashboard_summary_category", _dashboard_sql("error"), _DASHBOARD_DOUBLES, extra=_PIECES)
def dashboard_summary_category_q(spark, sf_dir):
    """VW14 for one category: its items, but every lot and piece."""
    return V.dashboard_summary(bundle(spark, sf_dir), EVENT_ITEMS, category="error")


@reg("color_levels", f"""
SELECT colname, {nice_upper_sql('a', 1.0)} AS ng_rate_max, {nice_upper_sql('b', 0.1)} AS normalized_mean_max,
  {nice_upper_sql('c', 0.1)} AS normalized_std_max
FROM (SELECT colname, quantile_cont(ng_rate, 0.995) AS a, quantile_cont(normalized_mean, 0.995) AS b,
        quantile_cont(normalized_std, 0.995) AS c FROM fmap GROUP BY colname)""",
     ["ng_rate_max", "normalized_mean_max", "normalized_std_max"])
def color_levels_q(spark, sf_dir):
    """AG12 (per-item position-map form)."""
    return L.color_levels(V.frame_map(bundle(spark, sf_dir), KNOWN))


@reg("trend_y_range", """
SELECT colname, lo - pad AS y_min, hi + pad AS y_max FROM (
  SELECT colname, lo, hi, CASE WHEN hi - lo > 0 THEN (hi - lo) * 0.08::DOUBLE
                              ELSE greatest(abs(hi) * 0.05::DOUBLE, 1.0::DOUBLE) END AS pad
  FROM (SELECT colname,
          least(min(minimum), min(maximum), min(CASE WHEN isfinite(spec_lower) THEN spec_lower END),
                min(CASE WHEN isfinite(spec_upper) THEN spec_upper END)) AS lo,
          greatest(max(minimum), max(maximum), min(CASE WHEN isfinite(spec_lower) THEN spec_lower END),
                   min(CASE WHEN isfinite(spec_upper) THEN spec_upper END)) AS hi
        FROM trend GROUP BY colname))""", ["y_min", "y_max"])
def trend_y_range_q(spark, sf_dir):
    """AG13."""
    return L.trend_y_range(V.quality_trend(bundle(spark, sf_dir), KNOWN))


# --- KDE ------------------------------------------------------------------------------
KDE_CTES = f"""
hk AS (SELECT * FROM histogram WHERE colname IN (SELECT colname FROM known)),
kcounts AS (
  SELECT l.lot_number, l.lot_start_time, l.lot_index, k.colname, k.spec_order,
    coalesce(c.sample_count, 0) AS sample_count, coalesce(c.in_range_count, 0) AS in_range_count
  FROM lot_idx l CROSS JOIN known k
  LEFT JOIN (SELECT colname, lot_number, CAST(sum("count") AS BIGINT) AS sample_count,
               CAST(sum(CASE WHEN bin_index IS NOT NULL THEN "count" ELSE 0 END) AS BIGINT) AS in_range_count
             FROM hk GROUP BY colname, lot_number) c
    ON c.colname = k.colname AND c.lot_number = l.lot_number
  WHERE k.colname IN (SELECT colname FROM hk)
),
disp AS (
  SELECT colname,
    first(plot_min ORDER BY lot_start_time, coalesce(bin_index, {BINS})) AS plot_min,
    first(plot_max ORDER BY lot_start_time, coalesce(bin_index, {BINS})) AS plot_max,
    first(spec_lower ORDER BY lot_start_time, coalesce(bin_index, {BINS})) AS spec_lower,
    first(spec_upper ORDER BY lot_start_time, coalesce(bin_index, {BINS})) AS spec_upper,
    first(spec_best ORDER BY lot_start_time, coalesce(bin_index, {BINS})) AS spec_best
  FROM hk GROUP BY colname
),
ksm AS (
  SELECT colname, lot_number, bin_index + k_offset AS bin_index, sum(CAST("count" AS DOUBLE) * k_weight) AS smoothed
  FROM hk CROSS JOIN kernel
  WHERE hk.bin_index IS NOT NULL AND bin_index + k_offset >= 0 AND bin_index + k_offset < {BINS}
  GROUP BY colname, lot_number, bin_index + k_offset
),
kdense AS (
  SELECT c.colname, c.spec_order, c.lot_number, c.lot_index, b.bin_index, c.sample_count, c.in_range_count,
    coalesce(s.smoothed, 0.0::DOUBLE) AS smoothed, d.plot_min, d.plot_max,
    (d.plot_max - d.plot_min) / {float(BINS)!r}::DOUBLE AS step
  FROM kcounts c CROSS JOIN bins_t b
  LEFT JOIN ksm s ON s.colname = c.colname AND s.lot_number = c.lot_number AND s.bin_index = b.bin_index
  JOIN disp d ON d.colname = c.colname
),
kde AS (
  SELECT colname, spec_order, lot_number, lot_index, bin_index,
    CAST(bin_index AS DOUBLE) * step + plot_min + ((1.0::DOUBLE * step + plot_min) - (0.0::DOUBLE * step + plot_min))
      / 2.0::DOUBLE AS x,
    CASE WHEN sum(smoothed) OVER (PARTITION BY colname, lot_number) > 0
         THEN smoothed / sum(smoothed) OVER (PARTITION BY colname, lot_number) ELSE 0.0::DOUBLE END
      * (CAST(in_range_count AS DOUBLE) / CASE WHEN sample_count > 0 THEN CAST(sample_count AS DOUBLE) END)
      / ((1.0::DOUBLE * step + plot_min) - (0.0::DOUBLE * step + plot_min)) AS density,
    sample_count, in_range_count
  FROM kdense
)"""


@reg("kde_sample_counts", "SELECT colname, spec_order, lot_number, lot_start_time, lot_index, sample_count, "
     "in_range_count FROM kcounts", extra=KDE_CTES)
def kde_sample_counts_q(spark, sf_dir):
    """AG10: dense (item, lot) samples and in-range samples."""
    return K.kde_sample_counts(bundle(spark, sf_dir), KNOWN, bins=BINS)


@reg("lot_kde", "SELECT * FROM kde", ["x", "density"], extra=KDE_CTES)
def lot_kde_q(spark, sf_dir):
    """VW10/KDE1 + JN7 + WN1/WN2: dense 60-bin density per (item, lot)."""
    return K.lot_kde(bundle(spark, sf_dir), KNOWN, bins=BINS)


@reg("outside_rate", "SELECT colname, lot_number, 1.0::DOUBLE - CAST(in_range_count AS DOUBLE) / CASE WHEN "
     "sample_count > 0 THEN CAST(sample_count AS DOUBLE) END AS outside_rate FROM kcounts",
     ["outside_rate"], extra=KDE_CTES)
def outside_rate_q(spark, sf_dir):
    """AG11 per (item, lot)."""
    c = K.kde_sample_counts(bundle(spark, sf_dir), KNOWN, bins=BINS)
    rate = F.lit(1.0) - F.col("in_range_count").cast("double") / F.when(
        F.col("sample_count") > 0, F.col("sample_count").cast("double"))
    return c.select("colname", "lot_number", rate.alias("outside_rate"))


@reg("kde_context", """
SELECT d.colname, d.plot_min, d.plot_max, d.spec_lower,
  CASE WHEN isfinite(d.spec_lower) AND isfinite(d.spec_upper) THEN (d.spec_lower + d.spec_upper) / 2.0::DOUBLE END
    AS spec_center,
  d.spec_upper, d.spec_best, greatest(1.0::DOUBLE, 1.12::DOUBLE * pk.peak) AS y_max,
  v.min_sample_count, v.max_outside_rate
FROM disp d
JOIN (SELECT colname, max(density) AS peak FROM kde GROUP BY colname) pk ON pk.colname = d.colname
LEFT JOIN (SELECT colname, min(sample_count) AS min_sample_count,
             max(1.0::DOUBLE - CAST(in_range_count AS DOUBLE) / CASE WHEN sample_count > 0
                 THEN CAST(sample_count AS DOUBLE) END) AS max_outside_rate
           FROM kcounts WHERE lot_index >= greatest(0, (SELECT count(*) FROM lot_idx) - 8)
           GROUP BY colname) v ON v.colname = d.colname""",
     ["plot_min", "plot_max", "spec_lower", "spec_center", "spec_upper", "spec_best", "y_max", "max_outside_rate"],
     extra=KDE_CTES)
def kde_context_q(spark, sf_dir):
    """VW15 + AG14: per item display context over the default (last 8) lot window."""
    return K.kde_context(bundle(spark, sf_dir), KNOWN, bins=BINS)


# --- frames / paths ---------------------------------------------------------------------
def _edge(i: str) -> str:
    return f"(CASE WHEN {i} = {BINS} THEN hi ELSE CAST({i} AS DOUBLE) * ((hi - lo) / {float(BINS)!r}::DOUBLE) + lo END)"


_GUESS = (f"coalesce(least({BINS - 1}, greatest(0, CAST(floor((value - lo) / CASE WHEN (hi - lo) / "
          f"{float(BINS)!r}::DOUBLE <> 0 THEN (hi - lo) / {float(BINS)!r}::DOUBLE END) AS INTEGER))), 0)")

FRAME_CTES = f"""
fcells AS (
  SELECT lot_number, FrameNo, colname, PositionY, PositionX, value, normalized_value, ng_direction
  FROM targets
  QUALIFY row_number() OVER (PARTITION BY lot_number, FrameNo, colname, PositionY, PositionX
                             ORDER BY measure_id) = 1
),
fmeta AS (
  SELECT lot_number, FrameNo, colname, count(*) AS sample_count,
    first(limmin ORDER BY PositionY, PositionX, measure_id) AS spec_lower,
    first(limmax ORDER BY PositionY, PositionX, measure_id) AS spec_upper,
    first(meta_best ORDER BY PositionY, PositionX, measure_id) AS spec_best,
    first(meta_unit ORDER BY PositionY, PositionX, measure_id) AS meta_unit
  FROM targets GROUP BY lot_number, FrameNo, colname
),
fgrid AS (
  SELECT m.lot_number, m.FrameNo, m.colname, y.PositionY, x.PositionX, c.value, c.normalized_value,
    CAST(coalesce(c.ng_direction, 0) AS TINYINT) AS ng_direction,
    coalesce(c.ng_direction, 0) = -1 AS lower_ng, coalesce(c.ng_direction, 0) = 1 AS upper_ng,
    m.spec_lower, m.spec_upper, m.spec_best, m.meta_unit, m.sample_count
  FROM fmeta m CROSS JOIN ys y CROSS JOIN xs x
  LEFT JOIN fcells c ON c.lot_number = m.lot_number AND c.FrameNo = m.FrameNo AND c.colname = m.colname
    AND c.PositionY = y.PositionY AND c.PositionX = x.PositionX
),
fvals AS (
  SELECT lot_number, FrameNo, colname, min(value) AS vmin, max(value) AS vmax, count(*) AS n_values
  FROM fcells WHERE coalesce(isfinite(value), FALSE) GROUP BY lot_number, FrameNo, colname
),
frng0 AS (
  SELECT m.*, v.vmin, v.vmax, v.n_values,
    CASE WHEN isfinite(m.spec_lower) THEN m.spec_lower END AS l_,
    CASE WHEN isfinite(m.spec_upper) THEN m.spec_upper END AS u_,
    CASE WHEN isfinite(m.spec_best) THEN m.spec_best END AS b_,
    greatest(v.vmax - v.vmin, abs(v.vmax) * 0.01::DOUBLE, 1e-9::DOUBLE) AS rspan
  FROM fmeta m LEFT JOIN fvals v USING (lot_number, FrameNo, colname)
),
frng AS (
  SELECT *,
    CASE WHEN l_ IS NOT NULL AND u_ IS NOT NULL THEN l_ - (u_ - l_) / 4.0::DOUBLE
         WHEN u_ IS NOT NULL AND b_ IS NOT NULL THEN b_
         WHEN l_ IS NOT NULL AND b_ IS NOT NULL THEN l_ - (b_ - l_) / 5.0::DOUBLE
         ELSE vmin - rspan * 0.04::DOUBLE END AS lo,
    CASE WHEN l_ IS NOT NULL AND u_ IS NOT NULL THEN u_ + (u_ - l_) / 4.0::DOUBLE
         WHEN u_ IS NOT NULL AND b_ IS NOT NULL THEN b_ + (u_ - b_) * 1.2::DOUBLE
         WHEN l_ IS NOT NULL AND b_ IS NOT NULL THEN b_
         ELSE vmax + rspan * 0.04::DOUBLE END AS hi
  FROM frng0
),
fin0 AS (
  SELECT c.lot_number, c.FrameNo, c.colname, c.value, r.lo, r.hi, {_GUESS} AS g
  FROM fcells c JOIN frng r USING (lot_number, FrameNo, colname)
  WHERE coalesce(isfinite(c.value), FALSE) AND c.value >= r.lo AND c.value <= r.hi
),
fin1 AS (
  SELECT *, CASE WHEN g > 0 AND value < {_edge('g')} THEN g - 1 ELSE g END AS d FROM fin0
),
fbin AS (
  SELECT lot_number, FrameNo, colname,
    CASE WHEN d < {BINS - 1} AND value >= {_edge('d + 1')} THEN d + 1 ELSE d END AS b
  FROM fin1
),
fcnt AS (SELECT lot_number, FrameNo, colname, b, count(*) AS cnt FROM fbin GROUP BY lot_number, FrameNo, colname, b),
firange AS (SELECT lot_number, FrameNo, colname, CAST(sum(cnt) AS BIGINT) AS in_range_count FROM fcnt
            GROUP BY lot_number, FrameNo, colname),
fsm AS (
  SELECT lot_number, FrameNo, colname, b + k_offset AS bin_index, sum(CAST(cnt AS DOUBLE) * k_weight) AS smoothed
  FROM fcnt CROSS JOIN kernel WHERE b + k_offset >= 0 AND b + k_offset < {BINS}
  GROUP BY lot_number, FrameNo, colname, b + k_offset
),
fdense AS (
  SELECT r.lot_number, r.FrameNo, r.colname, t.bin_index, coalesce(s.smoothed, 0.0::DOUBLE) AS smoothed,
    coalesce(i.in_range_count, 0) AS in_range_count, CAST(coalesce(r.n_values, 0) AS BIGINT) AS sample_count,
    r.lo, r.hi, (r.hi - r.lo) / {float(BINS)!r}::DOUBLE AS step
  FROM frng r CROSS JOIN bins_t t
  LEFT JOIN fsm s ON s.lot_number = r.lot_number AND s.FrameNo = r.FrameNo AND s.colname = r.colname
    AND s.bin_index = t.bin_index
  LEFT JOIN firange i ON i.lot_number = r.lot_number AND i.FrameNo = r.FrameNo AND i.colname = r.colname
),
fkde AS (
  SELECT lot_number, FrameNo, colname, bin_index,
    CAST(bin_index AS DOUBLE) * step + lo + ((1.0::DOUBLE * step + lo) - (0.0::DOUBLE * step + lo)) / 2.0::DOUBLE AS x,
    CASE WHEN sum(smoothed) OVER (PARTITION BY lot_number, FrameNo, colname) > 0
         THEN smoothed / sum(smoothed) OVER (PARTITION BY lot_number, FrameNo, colname) ELSE 0.0::DOUBLE END
      * (CAST(in_range_count AS DOUBLE) / CASE WHEN sample_count > 0 THEN CAST(sample_count AS DOUBLE) END)
      / ((1.0::DOUBLE * step + lo) - (0.0::DOUBLE * step + lo)) AS density,
    sample_count, in_range_count, lo AS display_min, hi AS display_max
  FROM fdense
),
catalog AS (
  -- every other row of a path runs from right to left
  SELECT equipment_id, path_index, path_id, label, x AS PositionX, y AS PositionY,
    CAST(k * 24 + CASE WHEN k % 2 = 0 THEN x ELSE 25 - x END AS INTEGER) AS step
  FROM (
    SELECT 'row_serpentine' AS equipment_id, 0 AS path_index, 'main' AS path_id, 'processing path' AS label,
      CAST(PositionY - 1 AS INTEGER) AS k, PositionY AS y, PositionX AS x FROM ys CROSS JOIN xs
    UNION ALL
    SELECT 'mold_4flow', CAST((PositionY - 1) // 3 AS INTEGER), 'flow_' || CAST((PositionY - 1) // 3 + 1 AS VARCHAR),
      'resin flow ' || CAST((PositionY - 1) // 3 + 1 AS VARCHAR),
      CAST((PositionY - 1) % 3 AS INTEGER), PositionY, PositionX FROM ys CROSS JOIN xs)),
pseries AS (
  SELECT g.lot_number, g.FrameNo, g.colname, c.equipment_id, c.path_index, c.path_id,
    c.label, CAST(c.step AS INTEGER) AS step, g.PositionX, g.PositionY, g.value, g.ng_direction,
    g.spec_lower, g.spec_upper
  FROM fgrid g JOIN catalog c ON c.PositionX = g.PositionX AND c.PositionY = g.PositionY
)"""


@reg("frame_grid", "SELECT * FROM fgrid", ["value", "normalized_value", "spec_lower", "spec_upper", "spec_best"],
     extra=FRAME_CTES)
def frame_grid_q(spark, sf_dir):
    """VW7: dense 12 x 24 grid of every (lot, frame, item) with NG direction classes."""
    return FR.frame_grid(judged_events(spark, sf_dir))


@reg("frame_value_levels", "SELECT lot_number, FrameNo, colname, vmin AS raw_min, vmax AS raw_max, "
     "vmin - rspan * 0.04::DOUBLE AS level_min, vmax + rspan * 0.04::DOUBLE AS level_max FROM frng0 "
     "WHERE vmin IS NOT NULL", ["raw_min", "raw_max", "level_min", "level_max"], extra=FRAME_CTES)
def frame_value_levels_q(spark, sf_dir):
    """AG16."""
    return FR.frame_value_levels(judged_events(spark, sf_dir))


@reg("frame_kde", "SELECT * FROM fkde", ["x", "density", "display_min", "display_max"], extra=FRAME_CTES)
def frame_kde_q(spark, sf_dir):
    """VW11/KDE2: dense 60-bin density of every (lot, frame, item)."""
    return K.frame_kde(judged_events(spark, sf_dir), BINS)


@reg("path_series", "SELECT * FROM pseries", ["value", "spec_lower", "spec_upper"], extra=FRAME_CTES)
def path_series_q(spark, sf_dir):
    """VW12/JN3: every frame grid along the paths of both machines."""
    grid = FR.frame_grid(judged_events(spark, sf_dir))
    return FR.path_series(grid, path_catalog(spark))


@reg("path_plot_range", """
SELECT lot_number, FrameNo, colname, equipment_id,
  x_lo - greatest(1.0::DOUBLE, CAST(x_hi - x_lo AS DOUBLE)) * 0.03::DOUBLE AS x_min,
  x_hi + greatest(1.0::DOUBLE, CAST(x_hi - x_lo AS DOUBLE)) * 0.03::DOUBLE AS x_max,
  y_lo - greatest(1e-9::DOUBLE, y_hi - y_lo) * 0.08::DOUBLE AS y_min,
  y_hi + greatest(1e-9::DOUBLE, y_hi - y_lo) * 0.08::DOUBLE AS y_max
FROM (SELECT lot_number, FrameNo, colname, equipment_id, min(step) AS x_lo, max(step) AS x_hi,
        least(min(CASE WHEN isfinite(value) THEN value END), min(CASE WHEN isfinite(spec_lower) THEN spec_lower END),
              min(CASE WHEN isfinite(spec_upper) THEN spec_upper END)) AS y_lo,
        greatest(max(CASE WHEN isfinite(value) THEN value END), max(CASE WHEN isfinite(spec_lower) THEN spec_lower END),
                 max(CASE WHEN isfinite(spec_upper) THEN spec_upper END)) AS y_hi
      FROM pseries GROUP BY lot_number, FrameNo, colname, equipment_id)""",
     ["x_min", "x_max", "y_min", "y_max"], extra=FRAME_CTES)
def path_plot_range_q(spark, sf_dir):
    """AG15 per (frame grid, machine)."""
    grid = FR.frame_grid(judged_events(spark, sf_dir))
    return FR.path_plot_range(FR.path_series(grid, path_catalog(spark)))


@reg("kde_y_max", "SELECT colname, greatest(1.0::DOUBLE, 1.12::DOUBLE * max(density)) AS y_max FROM kde "
     "GROUP BY colname", ["y_max"], extra=KDE_CTES)
def kde_y_max_q(spark, sf_dir):
    """AG14, lot form: per item over all lots."""
    return K.kde_y_max(K.lot_kde(bundle(spark, sf_dir), KNOWN, bins=BINS), ["colname"])


@reg("frame_kde_y_max", "SELECT lot_number, FrameNo, colname, greatest(1.0::DOUBLE, 1.12::DOUBLE * max(density)) "
     "AS y_max FROM fkde GROUP BY lot_number, FrameNo, colname", ["y_max"], extra=FRAME_CTES)
def frame_kde_y_max_q(spark, sf_dir):
    """AG14, frame form: per (lot, frame, item)."""
    return K.kde_y_max(K.frame_kde(judged_events(spark, sf_dir), BINS), ["lot_number", "FrameNo", "colname"])
