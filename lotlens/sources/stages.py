"""Detail stages (raw, standardized, judged): versioned folders behind a pointer.

A write goes to a folder of its own below the stage's path.  Only when its rows have been
counted and found right does the pointer file, renamed over the old one, name it; a write that fails or
falls short is removed, and readers keep the version that was there.

    <path>/stage.json             which version is current, its rows, files and bytes
    <path>/v-<id>/rows/start_date=.../
    <path>/v-<id>/lots/           rows per lot and start date (judged stage)
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotlens.contracts import JUDGED_SCHEMA, RAW_SCHEMA, STANDARDIZED_SCHEMA
from lotlens.sources.files import folders, read_text, remove_folder, write_text_atomic
from lotlens.sources.raw import read_typed

STAGE_SCHEMAS = {"raw": RAW_SCHEMA, "standardized": STANDARDIZED_SCHEMA, "judged": JUDGED_SCHEMA}

#: Partition folder of the stages: the day a lot started.  A folder holds many
#: lots, so the number of folders follows the calendar, not the lots.
START_DATE = "start_date"

POINTER = "stage.json"

#: Text columns of few values: always written with a dictionary, which point lookups prune row groups by.
DICTIONARY_COLUMNS = ("vision", "lot_number", "colname", "meta_type", "meta_category", "meta_unit")
#: Keys of point lookups.  Where a row group has too many values for a dictionary, a bloom filter stands in.
LOOKUP_COLUMNS = ("lot_number", "colname")
ZSTD_LEVEL = 6
ROW_GROUP_BYTES = 128 << 20
LOOKUP_VALUES = 100_000


def parquet_options(df: DataFrame, row_group_bytes: int = ROW_GROUP_BYTES) -> dict[str, str]:
    """Parquet writer settings for a table with some of the stages' columns."""
    out = {"compression": "zstd", "parquet.compression.codec.zstd.level": str(ZSTD_LEVEL),
           "parquet.block.size": str(row_group_bytes), "parquet.enable.dictionary": "false"}
    for c in df.columns:
        if c in DICTIONARY_COLUMNS:
            out[f"parquet.enable.dictionary#{c}"] = "true"
        if c in LOOKUP_COLUMNS:
            out |= {f"parquet.bloom.filter.enabled#{c}": "true",
                    f"parquet.bloom.filter.expected.ndv#{c}": str(LOOKUP_VALUES)}
    return out


def lay_out(df: DataFrame) -> DataFrame:
    """Range layout for the first write of the detail: rows of a lot together,
    a large lot split over many tasks.  Later stages keep it without moving anything."""
    keys = [c for c in ("lot_start_time", "lot_number", "FrameNo", "colname", "PositionY", "PositionX")
            if c in df.columns]
    return df.repartitionByRange(*keys).sortWithinPartitions(*keys)


def _with_stage_metadata(df: DataFrame, stage: str, version: str) -> DataFrame:
    """Stage/version ride on the ``value`` column's field metadata, which
    survives Parquet (a partition column would lose it)."""
    target = "value" if "value" in df.columns else df.columns[0]
    meta = {"dataset_stage": stage, "dataset_version": version}
    return df.withColumn(target, F.col(target).alias(target, metadata=meta))


def dataset_stage(df: DataFrame) -> str | None:
    """Stage recorded in the schema metadata, if any."""
    for field in df.schema.fields:
        if "dataset_stage" in field.metadata:
            return field.metadata["dataset_stage"]
    return None


def stored_counts(spark: SparkSession, folder: str) -> dict[str, int]:
    """Rows, files and bytes of the Parquet files below ``folder``, from their footers: no column is read."""
    files = (spark.read.parquet(folder).groupBy("_metadata.file_path")
             .agg(F.count(F.lit(1)).alias("rows"), F.max("_metadata.file_size").alias("bytes")))
    r = files.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("files"),
                  F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    return {"rows": int(r["rows"]), "files": int(r["files"]), "bytes": int(r["bytes"])}


def write_stage(df: DataFrame, path: str, stage: str, *, version: str = "1",
                expected_rows: int | Observation | None = None, row_group_bytes: int = ROW_GROUP_BYTES) -> int:
    """Write one detail stage as Parquet, a folder per start date, rows in the order they come (no
    shuffle; lay the raw stage out once with ``lay_out``), check it and publish it.

    Returns the row count.  The rows that the write has seen must be those of ``expected_rows`` (a
    number, or an observation of the input in the same plan) and those that the written files hold; if not,
    or if the write fails, the new version is removed, the old one stays published and the error is raised.
    """
    if stage not in STAGE_SCHEMAS:
        raise ValueError(f"unknown stage {stage!r}")
    spark, base, folder = df.sparkSession, path.rstrip("/"), f"v-{uuid.uuid4().hex}"
    seen = Observation(f"rows_{stage}")
    out = _with_stage_metadata(df, stage, version).observe(seen, F.count(F.lit(1)).alias("rows"))
    try:
        (out.withColumn(START_DATE, F.to_date("lot_start_time"))
         .write.options(**parquet_options(df, row_group_bytes)).partitionBy(START_DATE).parquet(f"{base}/{folder}/rows"))
        rows = int(seen.get["rows"])
        expected = int(expected_rows.get["rows"]) if isinstance(expected_rows, Observation) else expected_rows
        if expected is not None and rows != expected:
            raise RuntimeError(f"{stage}: wrote {rows} rows, expected {expected}")
        # without rows there are no files either, and nothing to infer a schema from
        stored = stored_counts(spark, f"{base}/{folder}/rows") if rows else {"rows": 0, "files": 0, "bytes": 0}
        if stored["rows"] != rows:
            raise RuntimeError(f"{stage}: wrote {rows} rows, the files hold {stored['rows']}")
        if stage == "judged" and rows:
            (_dated(spark, f"{base}/{folder}/rows").groupBy("lot_number", START_DATE).agg(F.count(F.lit(1)).alias("rows"))
             .write.option("compression", "zstd").parquet(f"{base}/{folder}/lots"))
    except BaseException:
        remove_folder(spark, f"{base}/{folder}")
        raise
    about = {"dataset_stage": stage, "dataset_version": version, "path": folder, **stored}
    write_text_atomic(spark, f"{base}/{POINTER}", json.dumps(about, indent=2))
    return rows


def _dated(spark: SparkSession, folder: str) -> DataFrame:
    """lot_number and start_date of written rows."""
    schema = T.StructType([T.StructField("lot_number", T.StringType()), T.StructField(START_DATE, T.DateType())])
    return spark.read.schema(schema).parquet(folder)


def stage_about(spark: SparkSession, path: str) -> dict | None:
    """What the pointer of a stage says; None if ``path`` is no published stage (files of other writers)."""
    try:
        return json.loads(read_text(spark, f"{path.rstrip('/')}/{POINTER}"))
    except FileNotFoundError:
        return None


def stage_folder(spark: SparkSession, path: str) -> str:
    """Folder of the current version's rows; ``path`` itself if it is no published stage."""
    about = stage_about(spark, path)
    return path if about is None else f"{path.rstrip('/')}/{about['path']}/rows"


def read_stage(spark: SparkSession, path: str, stage: str, *, dated: bool = False) -> DataFrame:
    """The current version of a stage (or Parquet of other writers) under the stage's schema.

    ``dated`` keeps the partition column ``start_date``, which lookups by lot prune folders with.
    """
    schema, about = STAGE_SCHEMAS[stage], stage_about(spark, path)
    if about is not None and about["dataset_stage"] != stage:
        raise ValueError(f"{path}: expected stage {stage!r}, found {about['dataset_stage']!r}")
    if about is not None and not about["rows"]:
        empty = spark.createDataFrame([], schema)
        return empty.withColumn(START_DATE, F.lit(None).cast("date")) if dated else empty
    if dated:
        schema = T.StructType([*schema.fields, T.StructField(START_DATE, T.DateType())])
    df = read_typed(spark, path if about is None else f"{path.rstrip('/')}/{about['path']}/rows", schema)
    found = dataset_stage(df)
    if found not in (None, stage):
        raise ValueError(f"{path}: expected stage {stage!r}, found {found!r}")
    return df


def read_raw(spark: SparkSession, path: str, *, with_measure_id: bool = False) -> DataFrame:
    """Scan a raw stage.  Predicates are pushed into the Parquet scan by Catalyst."""
    df = read_stage(spark, path, "raw")
    return df if with_measure_id else df.select(*[f.name for f in RAW_SCHEMA.fields])


def lot_days(spark: SparkSession, path: str) -> DataFrame:
    """(lot_number, start_date, rows) of a published judged stage: where its lots lie."""
    about = stage_about(spark, path)
    schema = T.StructType([T.StructField("lot_number", T.StringType()), T.StructField(START_DATE, T.DateType()),
                           T.StructField("rows", T.LongType())])
    if about is None or about["dataset_stage"] != "judged":
        raise ValueError(f"{path} is no published judged stage")
    if not about["rows"]:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path.rstrip('/')}/{about['path']}/lots")


def select_frame(judged: DataFrame, lot: str | None = None, frame: int | None = None,
                 colname: str | None = None, days: DataFrame | None = None) -> DataFrame:
    """``judged`` of one lot, frame or item (as far as given), before anything else happens to it.

    With ``days`` (``lot_days`` of the stage, or any table of lot_number and start_date) and a ``judged``
    read with ``dated``, the lot's start dates become literals of the plan: only their folders are listed and read.
    Inside, row groups are skipped by their statistics and dictionaries.
    """
    if lot is not None:
        if days is not None and START_DATE in judged.columns:
            found = [r[0] for r in days.filter(F.col("lot_number") == lot).select(START_DATE).distinct().collect()]  # nearly always one
            on = F.col(START_DATE).isin([d for d in found if d is not None])
            judged = judged.filter(on | F.col(START_DATE).isNull() if None in found else on)
        judged = judged.filter(F.col("lot_number") == lot)
    if frame is not None:
        judged = judged.filter(F.col("FrameNo") == frame)
    if colname is not None:
        judged = judged.filter(F.col("colname") == colname)
    return judged


def remove_old_versions(spark: SparkSession, path: str) -> list[str]:
    """Remove all versions of a stage but the published one (old ones, and what a killed write has left).

    To be called by the stage's owner when no reader uses an older version any more and no write is under way.
    Returns the names of what was removed."""
    about = stage_about(spark, path)
    old = [f for f in folders(spark, path) if f.startswith("v-") and (about is None or f != about["path"])]
    for f in old:
        remove_folder(spark, f"{path.rstrip('/')}/{f}")
    return old
