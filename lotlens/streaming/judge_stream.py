"""Structured Streaming form of the pipeline.

Raw measurement files landing in a folder are standardised and judged as a
stream (both stages are stateless projections, so they run unchanged on a
streaming DataFrame).  Each micro-batch is appended to the judged stage, a
folder per start date, and the lot-keyed grains of the days it touched are
rebuilt from that stage, so a lot that arrives over several batches is always
aggregated whole.

Nothing that a reader may hold is overwritten: a batch writes its days to a folder of its own, and the
manifest, renamed over the old one at the end, names for each grain and day the folder and its row count.
A reader that has opened the bundle sees one batch's state whole; a replayed batch (after a failure) writes
another folder and names that.  A batch counts the rows of its own days; those of other days are in the manifest.

The histogram's display range is global over all lots, so it is rebuilt in
full when requested (``refresh_histogram``, between batches: the manifest has one writer).
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from lotlens.contracts import JUDGED_SCHEMA, KDE_BINS, RAW_SCHEMA
from lotlens.operators import aggregates as A
from lotlens.operators.rows import judge, standardize
from lotlens.sources.bundle import publish
from lotlens.sources.files import folders, read_text, remove_folder
from lotlens.sources.stages import START_DATE, parquet_options

LOT_GRAINS = ("lots", "frame_item_stats", "position_item_stats", "piece_ng")


def judged_stream(spark: SparkSession, raw_dir: str, *, max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming judged rows from Parquet files arriving in ``raw_dir``."""
    reader = spark.readStream.schema(RAW_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(raw_dir).transform(standardize).transform(judge)


def _lot_grains(judged: DataFrame, bit_items) -> dict[str, DataFrame]:
    return {
        "lots": A.lots(judged),
        "frame_item_stats": A.frame_item_stats(judged),
        "position_item_stats": A.position_item_stats(judged),
        "piece_ng": A.piece_ng(judged, bit_items),
    }


def _touched(batch: DataFrame) -> list:
    """Start dates of a batch's lots: partition folders of the judged stage (a row per calendar day)."""
    return [r[0] for r in batch.select(F.to_date("lot_start_time").alias("d")).distinct().collect()]


def _published(spark: SparkSession, base: str) -> dict:
    """Tables of the current manifest; none before the first batch."""
    try:
        return json.loads(read_text(spark, f"{base}/manifest.json"))["tables"]
    except FileNotFoundError:
        return {}


def _named(day) -> str:
    """The day's partition folder."""
    return f"{START_DATE}={'__HIVE_DEFAULT_PARTITION__' if day is None else day.isoformat()}"


def _written_days(df: DataFrame, base: str, folder: str) -> dict[str, dict]:
    """``df`` written below ``folder``, a folder per start date: path and rows of each day."""
    path = f"{base}/{folder}"
    df.withColumn(START_DATE, F.to_date("lot_start_time")).write.options(**parquet_options(df)).partitionBy(START_DATE).parquet(path)
    schema = T.StructType([T.StructField("lot_number", T.StringType()), T.StructField(START_DATE, T.DateType())])
    counts = df.sparkSession.read.schema(schema).parquet(path).groupBy(START_DATE).agg(F.count(F.lit(1)).alias("rows"))
    return {_named(r[START_DATE]): {"path": f"{folder}/{_named(r[START_DATE])}", "rows": r["rows"]} for r in counts.collect()}


def grain_refresher(judged_dir: str, bundle_dir: str, bit_items, bins: int = KDE_BINS):
    """``foreachBatch`` function: append the batch to the judged stage, then
    rebuild the grains of the days whose lots the batch touched, and publish.

    The judged stage is read under a literal list of those days, which prunes
    its folders: a batch costs what its days hold, not the whole history.
    """
    base = bundle_dir.rstrip("/")

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        # Append is keyed by batch id: a replayed batch overwrites its own file set.
        (batch.withColumn("_batch", F.lit(batch_id)).withColumn(START_DATE, F.to_date("lot_start_time"))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy(START_DATE, "_batch").parquet(judged_dir))
        days = _touched(batch)
        if not days:
            return
        detail, tables = touched_detail(spark, judged_dir, days), _published(spark, base)
        folder = f"batch-{batch_id}-{uuid.uuid4().hex}"
        for name, df in _lot_grains(detail, bit_items).items():
            found = _written_days(df, base, f"{folder}/{name}")
            kept = tables.get(name, {}).get("days", {})
            tables[name] = {"days": {**{d: m for d, m in kept.items() if d not in {_named(x) for x in days}}, **found}}
        _publish(spark, base, tables, bit_items, bins)

    return run


def judged_history(spark: SparkSession, judged_dir: str) -> DataFrame:
    """The judged stage under its schema, partition folders included."""
    schema = T.StructType([*JUDGED_SCHEMA.fields, T.StructField(START_DATE, T.DateType()),
                           T.StructField("_batch", T.LongType())])
    return spark.read.schema(schema).parquet(judged_dir)


def touched_detail(spark: SparkSession, judged_dir: str, days: list) -> DataFrame:
    """The judged rows of the given start dates; other folders are not read."""
    on = F.col(START_DATE).isin([d for d in days if d is not None])
    return (judged_history(spark, judged_dir).filter(on | F.col(START_DATE).isNull() if None in days else on)
            .drop(START_DATE, "_batch"))


def _publish(spark: SparkSession, base: str, tables: dict, bit_items, bins: int) -> None:
    for name in LOT_GRAINS:
        if name in tables:
            tables[name]["rows"] = sum(d["rows"] for d in tables[name]["days"].values())
    publish(spark, base, tables, bit_items=bit_items, bins=bins)


def start_pipeline(spark: SparkSession, raw_dir: str, judged_dir: str, bundle_dir: str,
                   checkpoint_dir: str, bit_items, *, available_now: bool = True) -> StreamingQuery:
    """Start the streaming pipeline; ``available_now`` processes what is there and stops."""
    stream = judged_stream(spark, raw_dir)
    writer = (stream.writeStream.foreachBatch(grain_refresher(judged_dir, bundle_dir, bit_items))
              .option("checkpointLocation", checkpoint_dir))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()


def refresh_histogram(spark: SparkSession, judged_dir: str, bundle_dir: str, bit_items,
                      bins: int = KDE_BINS) -> None:
    """Full rebuild of the lot histogram (global display range) in a folder of its own, then publish."""
    base, folder = bundle_dir.rstrip("/"), f"histogram-{uuid.uuid4().hex}"
    judged = judged_history(spark, judged_dir).drop(START_DATE, "_batch")
    histogram = A.lot_item_histogram(judged, bins)
    try:
        histogram.write.options(**parquet_options(histogram)).parquet(f"{base}/{folder}")
    except BaseException:
        remove_folder(spark, f"{base}/{folder}")
        raise
    rows = spark.read.parquet(f"{base}/{folder}").count()
    _publish(spark, base, {**_published(spark, base), "lot_item_histogram": {"path": folder, "rows": rows}}, bit_items, bins)


def remove_old_batches(spark: SparkSession, bundle_dir: str) -> list[str]:
    """Remove batch and histogram folders that the manifest names no more.

    To be called when no reader uses an older manifest any more and no batch is under way.
    Returns the names of what was removed."""
    base = bundle_dir.rstrip("/")
    named = set()
    for table in _published(spark, base).values():
        named |= {d["path"].split("/")[0] for d in table.get("days", {"": table}).values()}
    old = [f for f in folders(spark, base) if f.startswith(("batch-", "histogram-")) and f not in named]
    for f in old:
        remove_folder(spark, f"{base}/{f}")
    return old
