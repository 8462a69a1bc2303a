"""Data contracts: stage schemas, column orders, domain constants, item master.

A measurement row is one inspection item (``colname``) on one piece
(``PositionX``, ``PositionY``) of one frame (``FrameNo``) of one lot.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# --- fixed values (must equal the data model's) -----------------------------
FRAME_NUMBERS = tuple(range(1, 25))     # frames 1..24 per lot
POSITION_X = tuple(range(1, 25))        # piece columns 1..24
POSITION_Y = tuple(range(1, 13))        # piece rows 1..12
FRAME_CELLS = len(POSITION_X) * len(POSITION_Y)   # 288 pieces per frame
KDE_BINS = 60
KDE_BANDWIDTH_BINS = 1.5
VISIBLE_LOTS = 8
TARGET_META_TYPE = "spec"
MAX_BIT_ITEMS = 63                      # signed bigint mask, sign bit unused
RAW_SCHEMA = T.StructType([
    T.StructField("vision", T.StringType(), False),
    T.StructField("lot_number", T.StringType(), False),
    T.StructField("lot_start_time", T.TimestampNTZType(), False),
    T.StructField("FrameNo", T.ShortType(), False),
    T.StructField("PositionX", T.ByteType(), False),
    T.StructField("PositionY", T.ByteType(), False),
    T.StructField("value", T.DoubleType(), False),
    T.StructField("colname", T.StringType(), False),
    T.StructField("limmin", T.DoubleType(), True),
    T.StructField("limmax", T.DoubleType(), True),
    T.StructField("meta_type", T.StringType(), False),
    T.StructField("meta_ignore", T.BooleanType(), False),
    T.StructField("meta_best", T.DoubleType(), True),
    T.StructField("meta_category", T.StringType(), False),
    T.StructField("meta_unit", T.StringType(), False),
])
# -----------------------------------------------------------------------------

STANDARDIZED_ADDED = ("spec_position", "spec_usage")             # after value
JUDGED_ADDED = ("normalized_value", "normalized_deviation",
                "is_judgement_target", "is_ng", "ng_direction")  # after spec_usage

_ADDED_TYPES = {"spec_position": T.DoubleType(), "spec_usage": T.DoubleType(), "normalized_value": T.DoubleType(),
                "normalized_deviation": T.DoubleType(), "is_judgement_target": T.BooleanType(),
                "is_ng": T.BooleanType(), "ng_direction": T.ByteType()}

# Optional arrival-order column carried through every stage; the per-cell views
# keep the first measurement of a duplicated cell by it.
MEASURE_ID = "measure_id"


def insert_after(columns: list[str] | tuple[str, ...], anchor: str,
                 new: tuple[str, ...]) -> list[str]:
    """Column order with ``new`` placed right after ``anchor``; others unchanged."""
    out: list[str] = []
    for name in columns:
        if name in new:
            continue
        out.append(name)
        if name == anchor:
            out.extend(new)
    return out


def _with_added(schema: T.StructType, anchor: str, added: tuple[str, ...]) -> T.StructType:
    types = {f.name: f.dataType for f in schema.fields} | _ADDED_TYPES
    return T.StructType([T.StructField(n, types[n], True)
                         for n in insert_after([f.name for f in schema.fields], anchor, added)])


STANDARDIZED_SCHEMA = _with_added(RAW_SCHEMA, "value", STANDARDIZED_ADDED)
JUDGED_SCHEMA = _with_added(STANDARDIZED_SCHEMA, "spec_usage", JUDGED_ADDED)

# Column types of the analysis tables; files of other writers (unsigned masks,
# floating counts) are cast to them.
BUNDLE_TYPES = {
    "lot_number": "string", "lot_start_time": "timestamp_ntz", "vision": "string", "colname": "string",
    "meta_category": "string", "meta_unit": "string", "FrameNo": "smallint", "PositionX": "tinyint",
    "PositionY": "tinyint", "bin_index": "int", "is_ng": "boolean",
    **dict.fromkeys(("total_count", "sample_count", "ng_count", "count", "total_item_count", "ng_item_count",
                     "ng_mask"), "bigint"),
}


@dataclass(frozen=True)
class ItemSpec:
    """One inspection item with its specification."""

    colname: str
    limmin: float | None
    limmax: float | None
    meta_best: float | None
    meta_type: str = "spec"
    meta_ignore: bool = False
    meta_category: str = ""
    meta_unit: str = ""

    @property
    def base(self) -> str:
        return self.colname.rsplit("_v", 1)[0]

    @property
    def vision(self) -> str:
        return "vision_" + self.colname.rsplit("_v", 1)[1]


ITEM_SCHEMA = T.StructType([
    T.StructField("colname", T.StringType(), False),
    T.StructField("spec_order", T.IntegerType(), False),
    T.StructField("bit_value", T.LongType(), True),
    T.StructField("vision", T.StringType(), False),
    T.StructField("limmin", T.DoubleType(), True),
    T.StructField("limmax", T.DoubleType(), True),
    T.StructField("meta_type", T.StringType(), False),
    T.StructField("meta_ignore", T.BooleanType(), False),
    T.StructField("meta_best", T.DoubleType(), True),
    T.StructField("meta_category", T.StringType(), False),
    T.StructField("meta_unit", T.StringType(), False),
])


def check_items(items: tuple[ItemSpec, ...]) -> None:
    """Item master rules: unique names, at most 63 items (bit budget)."""
    check_item_names([item.colname for item in items])


def check_item_names(names: tuple[str, ...] | list[str]) -> None:
    """At most 63 different items: what fits the NG bit mask, and bounds every
    per-item table that is broadcast."""
    if len(names) != len(set(names)):
        raise ValueError("item master holds duplicate colnames")
    if len(names) > MAX_BIT_ITEMS:
        raise ValueError(f"at most {MAX_BIT_ITEMS} items fit the NG bit mask, got {len(names)}")


def _sql_literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, int):
        return f"{value}L"
    if isinstance(value, float):
        return f"CAST('{value!r}' AS DOUBLE)"
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def literal_table(spark: SparkSession, rows: list[tuple], schema: T.StructType) -> DataFrame:
    """A small constant table as one inline ``VALUES`` relation: parsed once in
    the JVM into a local relation, so using it never starts Python workers."""
    from pyspark.sql import functions as F

    names = [f"c{i}" for i in range(len(schema.fields))]
    if not rows:
        return spark.createDataFrame([], schema)
    values = ", ".join("(" + ", ".join(_sql_literal(v) for v in row) + ")" for row in rows)
    df = spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(names)})")
    return df.select(*[F.col(n).cast(f.dataType).alias(f.name) for n, f in zip(names, schema.fields)])


def item_dimension(spark: SparkSession, items: tuple[ItemSpec, ...]) -> DataFrame:
    """Item master as a small DataFrame (<= 63 rows, checked), safe to broadcast."""
    check_items(items)
    rows = [
        (it.colname, i, 1 << i, it.vision, it.limmin, it.limmax, it.meta_type,
         it.meta_ignore, it.meta_best, it.meta_category, it.meta_unit)
        for i, it in enumerate(items)
    ]
    return literal_table(spark, rows, ITEM_SCHEMA)
