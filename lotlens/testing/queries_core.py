"""Registered queries: sources, row stages, grains and checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotlens.contracts import MEASURE_ID
from lotlens.functions.scalar import floor_bin
from lotlens.operators import aggregates as A
from lotlens.operators import checks as C
from lotlens.operators.rows import judge, standardize
from lotlens.plans.pipeline import ingest, judge_stage, standardize_stage
from lotlens.sources.bundle import build_bundle, open_bundle
from lotlens.sources.fixtures import EVENT_ITEMS, events_raw, lineitem_raw
from lotlens.sources.stages import lot_days, read_raw, read_stage
from lotlens.testing.registry import register, scratch_dir

BIT_ITEMS = tuple(i.colname for i in EVENT_ITEMS)


def judged_events(spark, sf_dir):
    return events_raw(spark, sf_dir).transform(standardize).transform(judge)


def _judged_cols():
    return ("vision, lot_number, lot_start_time, FrameNo, PositionX, PositionY, value, spec_position, "
            "spec_usage, normalized_value, normalized_deviation, is_judgement_target, is_ng, "
            "ng_direction, colname, limmin, limmax, meta_type, meta_ignore, meta_best, meta_category, "
            "meta_unit, measure_id")


# --- sources / sinks ----------------------------------------------------------
@register("raw_scan", "SELECT vision, lot_number, lot_start_time, FrameNo, PositionX, PositionY, value, "
          "colname, limmin, limmax, meta_type, meta_ignore, meta_best, meta_category, meta_unit, "
          "measure_id FROM raw", ["value", "limmin", "limmax", "meta_best"])
def raw_scan(spark, sf_dir):
    """SRC1 + SNK1: lay the raw stage out, scan it back."""
    path = scratch_dir(spark, "raw")
    ingest(events_raw(spark, sf_dir), path)
    return read_raw(spark, path, with_measure_id=True)


@register("melt_measures", "SELECT vision, lot_number, lot_start_time, FrameNo, PositionX, PositionY, "
          "value, colname, limmin, limmax, meta_type, meta_ignore, meta_best, meta_category, meta_unit "
          "FROM raw", ["value", "limmin", "limmax", "meta_best"], source="lineitem")
def melt_measures(spark, sf_dir):
    """SRC6: lineitem's four measures melted to one row per piece x item."""
    return lineitem_raw(spark, sf_dir)


@register("melt_frame_stats", """
SELECT lot_number, FrameNo, colname, count(*) AS total_count,
  CAST(count_if(is_ng) AS BIGINT) AS ng_count,
  CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) / count(*) AS mean_value
FROM targets GROUP BY lot_number, FrameNo, colname""", ["mean_value"], source="lineitem")
def melt_frame_stats(spark, sf_dir):
    """Melted lineitem through the stages: N, NG and exact mean per frame cell."""
    j = lineitem_raw(spark, sf_dir).transform(standardize).transform(judge)
    return j.filter("is_judgement_target").groupBy("lot_number", "FrameNo", "colname").agg(
        F.count(F.lit(1)).alias("total_count"),
        F.count_if(F.col("is_ng")).alias("ng_count"),
        (F.sum(F.col("value").cast("decimal(18,4)")).cast("double") / F.count(F.lit(1))).alias("mean_value"),
    )


def written_judged(spark, sf_dir) -> str:
    """Path of a published judged stage, all stages written on the way."""
    _, stage = ingest(events_raw(spark, sf_dir), scratch_dir(spark, "raw"))
    _, stage = standardize_stage(spark, stage, scratch_dir(spark, "standardized"))
    return judge_stage(spark, stage, scratch_dir(spark, "judged"))[1]


@register("stage_write", """
SELECT lot_number, count(*) AS rows_in, count(*) AS rows_out, TRUE AS ok FROM raw GROUP BY lot_number""")
def stage_write(spark, sf_dir):
    """SNK1 + CHK1: all stages written and read back, rows in == rows out per lot."""
    return C.row_count_check(events_raw(spark, sf_dir), read_stage(spark, written_judged(spark, sf_dir), "judged"))


@register("lot_days", """
SELECT lot_number, CAST(CAST(lot_start_time AS DATE) AS VARCHAR) AS start_date, count(*) AS rows
FROM judged GROUP BY lot_number, CAST(lot_start_time AS DATE)""")
def lot_days_q(spark, sf_dir):
    """SNK1 metadata: where each lot of a published judged stage lies, and its rows."""
    return lot_days(spark, written_judged(spark, sf_dir)).withColumn("start_date", F.col("start_date").cast("string"))


@register("row_count_check", """
SELECT lot_number, count(*) AS rows_in, count(*) AS rows_out, TRUE AS ok FROM raw GROUP BY lot_number""")
def row_count_check(spark, sf_dir):
    """CHK1 in memory: per-lot rows of raw vs judged."""
    raw = events_raw(spark, sf_dir)
    return C.row_count_check(raw, raw.transform(standardize).transform(judge))


def written_bundle(spark, sf_dir) -> dict:
    path = scratch_dir(spark, "bundle")
    build_bundle(judged_events(spark, sf_dir), path, bit_items=BIT_ITEMS)
    return open_bundle(spark, path)


# --- row stages -----------------------------------------------------------------
_JUDGED_DOUBLES = ["value", "spec_position", "spec_usage", "normalized_value", "normalized_deviation",
                   "limmin", "limmax", "meta_best"]


@register("standardize", "SELECT vision, lot_number, lot_start_time, FrameNo, PositionX, PositionY, "
          "value, spec_position, spec_usage, colname, limmin, limmax, meta_type, meta_ignore, meta_best, "
          "meta_category, meta_unit, measure_id FROM std",
          ["value", "spec_position", "spec_usage", "limmin", "limmax", "meta_best"])
def standardize_q(spark, sf_dir):
    """PRJ1/PRJ2/PRJ8: the standardized stage."""
    return events_raw(spark, sf_dir).transform(standardize)


@register("judge", f"SELECT {_judged_cols()} FROM judged", _JUDGED_DOUBLES)
def judge_q(spark, sf_dir):
    """PRJ3-PRJ9: the judged stage (standardize then judge)."""
    return judged_events(spark, sf_dir)


def _projection(key: str, column: str, is_double: bool):
    @register(key, f"SELECT measure_id, colname, {column} FROM judged", [column] if is_double else [])
    def q(spark, sf_dir):
        return judged_events(spark, sf_dir).select(MEASURE_ID, "colname", column)
    q.__doc__ = f"One judged column: {column}."
    return q


for _key, _col, _dbl in (
        ("spec_position", "spec_position", True),
        ("spec_usage", "spec_usage", True),
        ("normalized_value", "normalized_value", True),
        ("normalized_deviation", "normalized_deviation", True),
        ("judgement_target", "is_judgement_target", False),
        ("is_ng", "is_ng", False),
        ("ng_direction", "ng_direction", False)):
    _projection(_key, _col, _dbl)


# --- grains -------------------------------------------------------------------
@register("lots", "SELECT lot_number, min(lot_start_time) AS lot_start_time FROM judged GROUP BY lot_number")
def lots_q(spark, sf_dir):
    """AG1: lot -> start time over all rows."""
    return A.lots(judged_events(spark, sf_dir))


def order_statistic(values: str, p: float) -> str:
    """Linear interpolation at rank p (n - 1) of a sorted list (null for an empty one)."""
    rank = f"({p!r}::DOUBLE * (len({values}) - 1))"
    low, high = (f"{values}[CAST({f}({rank}) AS BIGINT) + 1]" for f in ("floor", "ceil"))
    return f"CASE WHEN len({values}) > 0 THEN {low} + ({high} - {low}) * ({rank} - floor({rank})) END"


def spread_around_mean(values: str) -> str:
    """Population standard deviation of a list, from the squared distances to its mean."""
    return (f"CASE WHEN len({values}) > 0 THEN sqrt(list_sum(list_transform({values}, lambda x: "
            f"(x - list_avg({values})) * (x - list_avg({values})))) / len({values})) END")


def group_sql(keys: str, more: str = "", columns: str = "") -> str:
    """Per group: lists of what was measured; everything else is taken from the lists."""
    return f"""
SELECT {keys}, lot_start_time, meta_category, meta_unit, {columns}
  len(flags) AS total_count, CAST(len(measured) AS BIGINT) AS sample_count,
  CAST(len(list_filter(flags, lambda f: f)) AS BIGINT) AS ng_count,
  len(list_filter(flags, lambda f: f)) * 100.0::DOUBLE / len(flags) AS ng_rate,
  CASE WHEN len(deviations) > 0 THEN list_sum(deviations) / len(deviations) END AS normalized_mean,
  {spread_around_mean('positions')} AS normalized_std{more}
FROM (
  SELECT {keys}, arg_min(lot_start_time, lot_start_time) AS lot_start_time,
    list_sort(list(DISTINCT meta_category))[1] AS meta_category, list_sort(list(DISTINCT meta_unit))[1] AS meta_unit,
    list_sort(list(limmin) FILTER (limmin IS NOT NULL)) AS lowers,
    list_sort(list(limmax) FILTER (limmax IS NOT NULL)) AS uppers,
    list_sort(list(meta_best) FILTER (meta_best IS NOT NULL)) AS bests,
    list(is_ng) AS flags, coalesce(list_sort(list(value) FILTER (value IS NOT NULL)), []) AS measured,
    coalesce(list(normalized_deviation) FILTER (normalized_deviation IS NOT NULL), []) AS deviations,
    coalesce(list(normalized_value) FILTER (normalized_value IS NOT NULL), []) AS positions
  FROM targets GROUP BY {keys})"""


FRAME_STATS_SQL = group_sql("lot_number, FrameNo, vision, colname", ", measured[1] AS minimum, " + ", ".join(
    f"{order_statistic('measured', p)} AS {n}" for n, p in zip(A.QUANTILE_NAMES, A.QUANTILES, strict=True))
    + ", measured[-1] AS maximum", "lowers[1] AS spec_lower, uppers[-1] AS spec_upper, bests[1] AS spec_best,")
FRAME_STATS_DOUBLES = ["spec_lower", "spec_upper", "spec_best", "ng_rate", "normalized_mean",
                       "normalized_std", "minimum", "p05", "p25", "p50", "p75", "p95", "maximum"]


@register("frame_item_stats", FRAME_STATS_SQL, FRAME_STATS_DOUBLES)
def frame_item_stats_q(spark, sf_dir):
    """AG2: per (lot, frame, item) counts, NG rate, normalised mean/std, exact quantiles."""
    return A.frame_item_stats(judged_events(spark, sf_dir))


POSITION_STATS_SQL = group_sql("lot_number, vision, colname, PositionX, PositionY")


@register("position_item_stats", POSITION_STATS_SQL, ["ng_rate", "normalized_mean", "normalized_std"])
def position_item_stats_q(spark, sf_dir):
    """AG3: per (lot, item, X, Y) across frames."""
    return A.position_item_stats(judged_events(spark, sf_dir))


# Display range by spec shape: plot_min and plot_max as weights of the lower limit, the upper limit and the best value.
BOUNDS_CTE = """
shapes(shape, min_l, min_u, min_b, max_l, max_u, max_b) AS (VALUES
  ('between',    1.25::DOUBLE, -0.25::DOUBLE,  0.0::DOUBLE, -0.25::DOUBLE, 1.25::DOUBLE,  0.0::DOUBLE),
  ('from best',  0.0::DOUBLE,   0.0::DOUBLE,   1.0::DOUBLE,  0.0::DOUBLE,  1.2::DOUBLE,  -0.2::DOUBLE),
  ('up to best', 1.2::DOUBLE,   0.0::DOUBLE,  -0.2::DOUBLE,  0.0::DOUBLE,  0.0::DOUBLE,   1.0::DOUBLE)),
per_item AS (
  SELECT colname, list_sort(list(value) FILTER (value IS NOT NULL)) AS vs,
    list_sort(list(DISTINCT limmin) FILTER (limmin IS NOT NULL))[1] AS spec_lower,
    list_sort(list(DISTINCT limmax) FILTER (limmax IS NOT NULL))[-1] AS spec_upper,
    list_sort(list(DISTINCT meta_best) FILTER (meta_best IS NOT NULL))[1] AS spec_best
  FROM targets GROUP BY colname),
extents AS (
  SELECT colname, vs[1] AS value_min, vs[-1] AS value_max, spec_lower, spec_upper, spec_best,
    list_sort(list_filter([vs[1], spec_lower, spec_upper], lambda x: x IS NOT NULL))[1] AS raw_min,
    list_sort(list_filter([vs[-1], spec_lower, spec_upper], lambda x: x IS NOT NULL))[-1] AS raw_max,
    CASE WHEN spec_lower + spec_upper IS NOT NULL THEN 'between' WHEN spec_upper + spec_best IS NOT NULL THEN 'from best'
         WHEN spec_lower + spec_best IS NOT NULL THEN 'up to best' END AS shape
  FROM per_item),
padding AS (
  SELECT *, 0.04::DOUBLE * list_sort([raw_max - raw_min, abs(raw_max) / 100.0::DOUBLE, 1e-9::DOUBLE])[-1] AS pad FROM extents),
bounds AS (
  SELECT colname, value_min, value_max, spec_lower, spec_upper, spec_best, raw_min, raw_max,
    CASE WHEN s.shape IS NULL THEN raw_min - pad ELSE
      min_l * coalesce(spec_lower, 0) + min_u * coalesce(spec_upper, 0) + min_b * coalesce(spec_best, 0) END AS plot_min,
    CASE WHEN s.shape IS NULL THEN raw_max + pad ELSE
      max_l * coalesce(spec_lower, 0) + max_u * coalesce(spec_upper, 0) + max_b * coalesce(spec_best, 0) END AS plot_max
  FROM padding p LEFT JOIN shapes s ON s.shape = p.shape)"""


@register("item_bounds", "SELECT * FROM bounds",
          ["value_min", "value_max", "spec_lower", "spec_upper", "spec_best", "raw_min", "raw_max",
           "plot_min", "plot_max"], extra_ctes=BOUNDS_CTE)
def item_bounds_q(spark, sf_dir):
    """AG4: global per-item value range and display range."""
    return A.item_bounds(judged_events(spark, sf_dir))


def histogram_ctes(bins: int) -> str:
    """Bins per item by the borders that a value has passed."""
    return BOUNDS_CTE + f""",
placed AS (
  -- the number of bin borders that the value has passed, in units of bins
  SELECT t.lot_number, t.lot_start_time, t.colname,
    CASE WHEN t.value BETWEEN b.plot_min AND b.plot_max AND NOT isnan(t.value) AND b.plot_max > b.plot_min
         THEN CAST(len(list_filter(range(1, {bins}), lambda k:
           k <= (t.value - b.plot_min) / (b.plot_max - b.plot_min) * {bins}::DOUBLE)) AS INTEGER) END AS bin_index
  FROM targets t JOIN bounds b USING (colname)),
histogram AS (
  SELECT p.lot_number, min(p.lot_start_time) AS lot_start_time, p.colname, bin_index, b.plot_min, b.plot_max,
    b.spec_lower, b.spec_upper, b.spec_best, count(*) AS "count",
    b.plot_min + (b.plot_max - b.plot_min) / {bins} * bin_index AS bin_left,
    b.plot_min + (b.plot_max - b.plot_min) / {bins} * (bin_index + 1) AS bin_right,
    b.plot_min + (b.plot_max - b.plot_min) / {2 * bins} * (2 * bin_index + 1) AS bin_center
  FROM placed p JOIN bounds b USING (colname) GROUP BY p.lot_number, p.colname, bin_index, b.plot_min, b.plot_max, b.spec_lower, b.spec_upper, b.spec_best)"""


HIST_DOUBLES = ["plot_min", "plot_max", "spec_lower", "spec_upper", "spec_best", "bin_left",
                "bin_right", "bin_center"]


@register("lot_item_histogram", "SELECT * FROM histogram", HIST_DOUBLES + ["bin_index"],
          extra_ctes=histogram_ctes(60))
def lot_item_histogram_q(spark, sf_dir):
    """AG5 + JN1: per (lot, item, bin) counts on the global display range (60 bins).
    (The nullable bin index is compared as a double: engines' pandas types differ.)"""
    h = A.lot_item_histogram(judged_events(spark, sf_dir), 60)
    return h.withColumn("bin_index", F.col("bin_index").cast("double"))


@register("histogram_bounds_join", """
SELECT colname, bin_index IS NULL AS out_of_range, count(*) AS rows
FROM placed GROUP BY colname, bin_index IS NULL""", extra_ctes=histogram_ctes(60))
def histogram_bounds_join_q(spark, sf_dir):
    """JN1: detail joined to the bounds; in/out-of-range rows per item."""
    j = judged_events(spark, sf_dir)
    b = A.checked_bounds(A.item_bounds(j)).select("colname", "plot_min", "plot_max")
    x = j.filter("is_judgement_target").join(F.broadcast(b), "colname")
    x = x.withColumn("out_of_range", floor_bin(F.col("value"), F.col("plot_min"), F.col("plot_max"), 60).isNull())
    return x.groupBy("colname", "out_of_range").agg(F.count(F.lit(1)).alias("rows"))


@register("bundle_build", """
SELECT 'lots' AS table_name, count(DISTINCT lot_number) AS manifest_rows,
       count(DISTINCT lot_number) AS read_rows FROM judged
UNION ALL SELECT 'frame_item_stats', count(*), count(*) FROM
  (SELECT DISTINCT lot_number, FrameNo, vision, colname FROM targets)
UNION ALL SELECT 'position_item_stats', count(*), count(*) FROM
  (SELECT DISTINCT lot_number, vision, colname, PositionX, PositionY FROM targets)
UNION ALL SELECT 'lot_item_histogram', count(*), count(*) FROM histogram
UNION ALL SELECT 'piece_ng', count(*), count(*) FROM
  (SELECT DISTINCT lot_number, FrameNo, PositionX, PositionY FROM targets)""", extra_ctes=histogram_ctes(60))
def bundle_build(spark, sf_dir):
    """SNK2/SNK3: build + publish the bundle, reopen it; manifest vs read counts."""
    b = written_bundle(spark, sf_dir)
    counts = [b[n].agg(F.count(F.lit(1)).alias("read_rows")).select(
        F.lit(n).alias("table_name"), F.lit(int(m["rows"])).cast("long").alias("manifest_rows"), "read_rows")
        for n, m in b["manifest"]["tables"].items()]
    return reduce(DataFrame.unionByName, counts)


def piece_sql(names) -> str:
    """A piece's mask is the sum of the different bits of its NG items."""
    bits = ", ".join(f"('{n}', CAST({1 << i} AS BIGINT))" for i, n in enumerate(names))
    return f"""
SELECT lot_number, arg_min(lot_start_time, lot_start_time) AS lot_start_time, FrameNo, PositionX, PositionY,
  count(colname) AS total_item_count, CAST(sum(CAST(is_ng AS INTEGER)) AS BIGINT) AS ng_item_count,
  CAST(coalesce(sum(DISTINCT bit) FILTER (is_ng), 0) AS BIGINT) AS ng_mask,
  coalesce(sum(DISTINCT bit) FILTER (is_ng), 0) > 0 AS is_ng
FROM targets LEFT JOIN (VALUES {bits}) AS item_bits(item, bit) ON item = colname
GROUP BY lot_number, FrameNo, PositionX, PositionY"""


PIECE_SQL = piece_sql(BIT_ITEMS)


@register("piece_ng", PIECE_SQL)
def piece_ng_q(spark, sf_dir):
    """AG6: per piece item count, NG item count, NG bit mask."""
    return A.piece_ng(judged_events(spark, sf_dir), BIT_ITEMS)


# --- checks ---------------------------------------------------------------------
@register("unit_consistency", """
SELECT colname, CAST(count_if(meta_unit IS NULL) AS BIGINT) AS null_units,
  count(DISTINCT meta_unit) AS distinct_units,
  count_if(meta_unit IS NULL) = 0 AND count(DISTINCT meta_unit) <= 1 AS ok
FROM targets GROUP BY colname""")
def unit_consistency_q(spark, sf_dir):
    """CHK5."""
    return C.unit_consistency(judged_events(spark, sf_dir))


NONNEG_CATEGORIES = ("error", "purchase")


_STAGE_ROWS = " UNION ALL ".join(
    f"SELECT '{stage}' AS stage, meta_category, value FROM {table}"
    for stage, table in (("raw", "raw"), ("standardized", "std"), ("judged", "judged")))


@register("nonnegative_check", f"""
SELECT stage, meta_category, count(*) AS rows, min(value) AS min_value,
  CAST(count_if(value < 0) AS BIGINT) AS negatives, count_if(value < 0) = 0 AS ok
FROM ({_STAGE_ROWS}) WHERE meta_category IN ('error', 'purchase') GROUP BY stage, meta_category""", ["min_value"])
def nonnegative_check_q(spark, sf_dir):
    """CHK6 on the non-negative categories of the fixture, at every stage."""
    raw = events_raw(spark, sf_dir)
    std = raw.transform(standardize)
    stages = {"raw": raw, "standardized": std, "judged": std.transform(judge)}
    return reduce(DataFrame.unionByName, [
        C.nonnegative_check(df, NONNEG_CATEGORIES).select(F.lit(name).alias("stage"), "*") for name, df in stages.items()])


@register("clean_measures", """
SELECT lot_number, lot_start_time, FrameNo, PositionX, PositionY, colname, count(*) AS rows,
  CAST(sum(CAST(CASE WHEN meta_category IN ('price', 'rate') AND value < 0 THEN 0 ELSE value END AS DECIMAL(18,4)))
       AS DOUBLE) AS total
FROM raw GROUP BY lot_number, lot_start_time, FrameNo, PositionX, PositionY, colname""", ["total"], source="lineitem")
def clean_measures_q(spark, sf_dir):
    """SRC6 with its cleaning step: categories clipped at 0, values rounded to 4 decimals."""
    x = lineitem_raw(spark, sf_dir, nonnegative=("price", "rate"))
    return x.groupBy("lot_number", "lot_start_time", "FrameNo", "PositionX", "PositionY", "colname").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("total"))


@register("frame_completeness", """
SELECT lot_number, FrameNo, colname, count(*) AS rows,
  count(DISTINCT (PositionX, PositionY)) AS cells,
  min(PositionX) AS min_x, max(PositionX) AS max_x, min(PositionY) AS min_y, max(PositionY) AS max_y,
  count(*) = 288 AND count(DISTINCT (PositionX, PositionY)) = 288 AND min(PositionX) = 1
    AND max(PositionX) = 24 AND min(PositionY) = 1 AND max(PositionY) = 12 AS complete
FROM targets GROUP BY lot_number, FrameNo, colname""")
def frame_completeness_q(spark, sf_dir):
    """CHK7."""
    return C.frame_completeness(judged_events(spark, sf_dir))


@register("quantile_monotone", """
SELECT colname, count(*) AS rows,
  CAST(count_if(coalesce(minimum > p05, FALSE) OR coalesce(p05 > p25, FALSE) OR coalesce(p25 > p50, FALSE)
    OR coalesce(p50 > p75, FALSE) OR coalesce(p75 > p95, FALSE) OR coalesce(p95 > maximum, FALSE)) AS BIGINT)
    AS violations,
  count_if(coalesce(minimum > p05, FALSE) OR coalesce(p05 > p25, FALSE) OR coalesce(p25 > p50, FALSE)
    OR coalesce(p50 > p75, FALSE) OR coalesce(p75 > p95, FALSE) OR coalesce(p95 > maximum, FALSE)) = 0 AS ok
FROM fstats GROUP BY colname""", extra_ctes=f"fstats AS ({FRAME_STATS_SQL})")
def quantile_monotone_q(spark, sf_dir):
    """CHK8 over frame_item_stats."""
    return C.quantile_monotone(A.frame_item_stats(judged_events(spark, sf_dir)))


@register("source_reconcile", """
SELECT f.colname, count(*) AS cells, CAST(count_if(f.FrameNo = 3 AND f.ng_count >= 0) AS BIGINT) AS mismatches,
  count_if(f.FrameNo = 3) = 0 AS ok
FROM fstats f GROUP BY f.colname""", extra_ctes=f"fstats AS ({FRAME_STATS_SQL})")
def source_reconcile_q(spark, sf_dir):
    """VW16: N/NG/quantiles of a written bundle against the detail.  One NG too many is
    planted in every cell of frame 3, and has to be found there and nowhere else."""
    stored = written_bundle(spark, sf_dir)["frame_item_stats"]
    planted = stored.withColumn("ng_count", F.col("ng_count") + (F.col("FrameNo") == 3).cast("int"))
    return C.source_reconcile(judged_events(spark, sf_dir), planted)


# --- the grains on the melted lineitem table (10x the rows of events) -----------------
from lotlens.sources.fixtures import LINEITEM_ITEMS  # noqa: E402

LINEITEM_BITS = tuple(i.colname for i in LINEITEM_ITEMS)


def judged_lineitem(spark, sf_dir):
    return lineitem_raw(spark, sf_dir).transform(standardize).transform(judge)


@register("lineitem_frame_item_stats", FRAME_STATS_SQL, FRAME_STATS_DOUBLES, source="lineitem")
def lineitem_frame_item_stats_q(spark, sf_dir):
    """AG2 over the melted lineitem measures."""
    return A.frame_item_stats(judged_lineitem(spark, sf_dir))


@register("lineitem_position_item_stats", POSITION_STATS_SQL, ["ng_rate", "normalized_mean", "normalized_std"],
          source="lineitem")
def lineitem_position_item_stats_q(spark, sf_dir):
    """AG3 over the melted lineitem measures."""
    return A.position_item_stats(judged_lineitem(spark, sf_dir))


@register("lineitem_lot_item_histogram", "SELECT * FROM histogram", HIST_DOUBLES + ["bin_index"],
          source="lineitem", extra_ctes=histogram_ctes(60))
def lineitem_lot_item_histogram_q(spark, sf_dir):
    """AG5 over the melted lineitem measures (bin index compared as double)."""
    h = A.lot_item_histogram(judged_lineitem(spark, sf_dir), 60)
    return h.withColumn("bin_index", F.col("bin_index").cast("double"))


@register("lineitem_piece_ng", piece_sql(LINEITEM_BITS),
          source="lineitem")
def lineitem_piece_ng_q(spark, sf_dir):
    """AG6 over the melted lineitem measures."""
    return A.piece_ng(judged_lineitem(spark, sf_dir), LINEITEM_BITS)
