"""Raw measurement sources.

* ``read_typed`` -- Parquet under a fixed schema (``stages.read_raw`` for the raw stage).
* ``melt_measures`` -- wide pieces (one column per measured item) to the long
  raw table, item metadata attached from the item master (broadcast, <= 63
  rows by contract).
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotlens.contracts import MEASURE_ID, RAW_SCHEMA, ItemSpec, item_dimension


_NANOS_AS_LONG = "spark.sql.legacy.parquet.nanosAsLong"


def _stored_schema(spark: SparkSession, paths: list[str]) -> T.StructType:
    """The files' own schema (footers only); nanosecond timestamps show as bigint."""
    try:
        return spark.read.parquet(*paths).schema
    except AnalysisException as refused:
        if "NANOS" not in str(refused):
            raise
    apart = spark.newSession()  # settings of its own: no other read of this session sees the switch
    apart.conf.set(_NANOS_AS_LONG, "true")
    return apart.read.parquet(*paths).schema


def read_typed(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    """Parquet below ``path`` (or several paths) with the columns and types of ``schema`` (and
    ``measure_id``, if stored).

    Text columns are declared, never inferred, so a lot that is a folder name
    (``lot_number=0012``) stays text.  Other stored types (unsigned or wider
    numbers) are cast.  Spark refuses nanosecond timestamps; such files are read
    as numbers and cut to microseconds.
    """
    wanted = {f.name: f for f in schema.fields}
    paths = [path] if isinstance(path, str) else list(path)
    stored = _stored_schema(spark, paths)
    declared = []
    for field in stored.fields:
        want = wanted.get(field.name)
        if want is not None and isinstance(want.dataType, T.StringType):
            field = T.StructField(field.name, T.StringType(), True, field.metadata)
        declared.append(field)
    numbers = {f.name for f in stored.fields if isinstance(f.dataType, T.LongType)}
    df = spark.read.schema(T.StructType(declared)).parquet(*paths)
    columns = []
    for field in [*schema.fields, *[f for f in stored.fields if f.name == MEASURE_ID and f.name not in wanted]]:
        value = F.col(field.name)
        if field.name in numbers and isinstance(field.dataType, (T.TimestampNTZType, T.TimestampType)):
            value = F.timestamp_micros(F.floor(value / F.lit(1000)).cast("long"))
        metadata = next((f.metadata for f in stored.fields if f.name == field.name), {})
        columns.append(value.cast(field.dataType).alias(field.name, metadata=metadata))
    return df.select(*columns)


def attach_items(long_df: DataFrame, spark: SparkSession,
                 items: tuple[ItemSpec, ...]) -> DataFrame:
    """Attach limits/metadata of the item master by ``colname``.  A measurement
    of an item that the master does not hold stops the job: it must not vanish.
    The names are checked on the join key itself, before the join, where no
    later filter can skip them.  The master is a driver-side list checked to <=
    63 rows, so the broadcast is bounded."""
    dim = item_dimension(spark, items).drop("spec_order", "bit_value", "vision")
    unknown = F.raise_error(F.concat(F.lit("item missing from the item master: "),
                                     F.coalesce(F.col("colname"), F.lit("null")))).cast("string")
    checked = F.when(F.col("colname").isin([i.colname for i in items]), F.col("colname")).otherwise(unknown)
    return long_df.withColumn("colname", checked).join(F.broadcast(dim), "colname", "inner")


def to_raw_order(df: DataFrame) -> DataFrame:
    extra = [MEASURE_ID] if MEASURE_ID in df.columns else []
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in RAW_SCHEMA.fields],
                     *extra)


def melt_measures(wide: DataFrame, spark: SparkSession, *, ids: list[str],
                  measures: dict[str, str], vision_index: Column,
                  items: tuple[ItemSpec, ...],
                  nonnegative: tuple[str, ...] | None = None) -> DataFrame:
    """Wide -> long.  ``measures`` maps base item name -> wide column; the
    ``_v{k}`` suffix comes from ``vision_index`` (1..3).  One output row per
    (piece, measured item).  With ``nonnegative`` (a list of categories, maybe
    empty) values are cleaned: those categories are clipped at 0 and every value is
    rounded to 4 decimals, half to even."""
    staged = wide.withColumn("_vision_k", vision_index.cast("int"))
    long_df = staged.unpivot(
        ids=[*ids, "_vision_k"],
        values=[F.col(c).cast("double").alias(base) for base, c in measures.items()],
        variableColumnName="_base",
        valueColumnName="value",
    )
    long_df = (
        long_df
        .withColumn("colname", F.concat(F.col("_base"), F.lit("_v"), F.col("_vision_k").cast("string")))
        .withColumn("vision", F.concat(F.lit("vision_"), F.col("_vision_k").cast("string")))
        .withColumn("value", F.when(F.col("value") == 0, F.lit(0.0)).otherwise(F.col("value")))
        .drop("_base", "_vision_k")
    )
    out = attach_items(long_df, spark, items)
    return out if nonnegative is None else clean_values(out, nonnegative)


def clean_values(long_df: DataFrame, nonnegative: tuple[str, ...]) -> DataFrame:
    """Values of the ``nonnegative`` categories clipped at 0, all rounded to 4 decimals (half to even)."""
    clipped = F.when(F.col("meta_category").isin(list(nonnegative)) & (F.col("value") < 0), F.lit(0.0)) \
        .otherwise(F.col("value"))
    return long_df.withColumn("value", F.bround(clipped, 4))
