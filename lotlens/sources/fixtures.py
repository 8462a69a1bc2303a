"""Adapters from the driver's test tables onto the raw measurement model.

``events`` becomes the primary raw stage (one event = one measurement), and
``lineitem`` is melted (four measures per line) as the scale input of the
unpivot.  The mappings below are part of the test contract: the DuckDB oracle
in ``__spark_entry__`` restates them in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotlens.contracts import MEASURE_ID, ItemSpec
from lotlens.sources.raw import attach_items, melt_measures, to_raw_order

# --- fixed values: item master of the events fixture -------------------------
# colname, limmin, limmax, meta_best, meta_type, meta_ignore; category =
# event type, unit 'u'.  Order = spec order (bit index).
_EVENT_ITEM_ROWS = (
    ("click_v1", 5.0, 150.0, None, "spec", False),
    ("click_v2", 5.0, 150.0, None, "spec", False),
    ("click_v3", 5.0, 150.0, None, "spec", False),
    ("error_v1", None, 120.0, 0.0, "spec", False),
    ("error_v2", None, 120.0, 0.0, "spec", False),
    ("error_v3", None, 120.0, 0.0, "spec", False),
    ("view_v1", 2.0, None, 200.0, "spec", False),
    ("view_v2", None, 130.0, None, "spec", False),
    ("view_v3", 10.0, 100.0, None, "spec", False),
    ("purchase_v1", 10.0, 100.0, None, "spec", False),
    ("purchase_v2", None, 90.0, 0.0, "spec", False),
    ("purchase_v3", 10.0, 100.0, None, "spec", True),
    ("signup_v1", None, None, None, "spec", False),
    ("signup_v2", 5.0, 150.0, None, "aux", False),
    ("signup_v3", 4.0, None, None, "spec", False),
)

# --- fixed values: lineitem measures and their specs -------------------------
# base item -> (wide column, limmin, limmax, meta_best, category, unit)
_LINEITEM_MEASURES = (
    ("quantity", "l_quantity", 5.0, 45.0, None, "count", "pcs"),
    ("extendedprice", "l_extendedprice", None, 90000.0, 0.0, "price", "usd"),
    ("discount", "l_discount", None, 0.08, 0.0, "rate", "ratio"),
    ("tax", "l_tax", None, 0.07, 0.0, "rate", "ratio"),
)
# -----------------------------------------------------------------------------

EVENT_ITEMS: tuple[ItemSpec, ...] = tuple(
    ItemSpec(colname=n, limmin=lo, limmax=hi, meta_best=best, meta_type=mt, meta_ignore=ign,
             meta_category=n.rsplit("_v", 1)[0], meta_unit="u")
    for (n, lo, hi, best, mt, ign) in _EVENT_ITEM_ROWS
)

LINEITEM_ITEMS: tuple[ItemSpec, ...] = tuple(
    ItemSpec(colname=f"{base}_v{k}", limmin=lo, limmax=hi, meta_best=best,
             meta_category=cat, meta_unit=unit)
    for (base, _c, lo, hi, best, cat, unit) in _LINEITEM_MEASURES
    for k in (1, 2, 3)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def events_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as raw measurements (15 raw columns + ``measure_id``).

    lot = day of ``ts``, frame = hour + 1, X = user % 24 + 1,
    Y = (user div 24) % 12 + 1, vision/suffix = event_id % 3 + 1.
    """
    k = "CAST(event_id % 3 + 1 AS STRING)"
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    long_df = events.selectExpr(
        f"concat('vision_', {k}) AS vision",
        "concat('LOT_', CAST(CAST(ts AS DATE) AS STRING)) AS lot_number",
        "CAST(CAST(ts AS DATE) AS TIMESTAMP_NTZ) AS lot_start_time",
        "CAST(hour(ts) + 1 AS SMALLINT) AS FrameNo",
        "CAST(user_id % 24 + 1 AS TINYINT) AS PositionX",
        "CAST(CAST(floor(user_id / 24) AS INT) % 12 + 1 AS TINYINT) AS PositionY",
        "value",
        f"concat(event_type, '_v', {k}) AS colname",
        f"event_id AS {MEASURE_ID}",
    )
    return to_raw_order(attach_items(long_df, spark, EVENT_ITEMS))


def lineitem_raw(spark: SparkSession, sf_dir: str, nonnegative: tuple[str, ...] | None = None) -> DataFrame:
    """``lineitem`` melted: lot = ship month, frame = min(day, 24),
    X = suppkey % 24 + 1, Y = partkey % 12 + 1, vision = linenumber % 3 + 1."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_shipdate", "l_suppkey", "l_partkey", "l_linenumber", *[c for (_b, c, *_r) in _LINEITEM_MEASURES])
    month = F.trunc(F.to_date("l_shipdate"), "month")
    wide = li.select(
        F.concat(F.lit("LOT_"), F.date_format(month, "yyyy-MM")).alias("lot_number"),
        month.cast("timestamp_ntz").alias("lot_start_time"),
        F.least(F.dayofmonth("l_shipdate"), F.lit(24)).cast("smallint").alias("FrameNo"),
        (F.col("l_suppkey") % 24 + 1).cast("tinyint").alias("PositionX"),
        (F.col("l_partkey") % 12 + 1).cast("tinyint").alias("PositionY"),
        (F.col("l_linenumber") % 3 + 1).alias("vision_k"),
        *[F.col(c) for (_b, c, *_r) in _LINEITEM_MEASURES],
    )
    long_df = melt_measures(
        wide, spark,
        ids=["lot_number", "lot_start_time", "FrameNo", "PositionX", "PositionY"],
        measures={b: c for (b, c, *_r) in _LINEITEM_MEASURES},
        vision_index=F.col("vision_k"),
        items=LINEITEM_ITEMS,
        nonnegative=nonnegative,
    )
    return to_raw_order(long_df)
