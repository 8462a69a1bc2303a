"""The analysis bundle (5 tables + manifest) and its reader.

Row counts come from ``DataFrame.observe`` on the writes themselves.  The manifest is written last,
through the Hadoop FileSystem of the target path (tmp file + rename over the
old one), and points at the folder of its build: ``open_bundle`` refuses a
folder without it, and sees one build whole.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotlens.contracts import BUNDLE_TYPES, KDE_BINS, check_item_names
from lotlens.operators import aggregates as A
from lotlens.sources.files import folders, read_text, remove_folder, write_text_atomic
from lotlens.sources.raw import read_typed
from lotlens.sources.stages import dataset_stage, parquet_options

BUNDLE_TABLES = ("lots", "frame_item_stats", "position_item_stats", "lot_item_histogram", "piece_ng")
GRAIN_COLUMNS = {
    "lots": ("lot_number", "lot_start_time"),
    "frame_item_stats": A.FRAME_STATS_COLUMNS,
    "position_item_stats": A.POSITION_STATS_COLUMNS,
    "lot_item_histogram": A.HISTOGRAM_COLUMNS,
    "piece_ng": A.PIECE_COLUMNS,
}
# Write-time orders of the grains; the first two columns deal rows to files.
_SORT = {
    "lots": ("lot_start_time", "lot_number"),
    "frame_item_stats": ("lot_start_time", "lot_number", "FrameNo", "colname"),
    "position_item_stats": ("lot_start_time", "lot_number", "colname", "PositionY", "PositionX"),
    "lot_item_histogram": ("lot_start_time", "lot_number", "colname", "bin_index"),
    "piece_ng": ("lot_start_time", "lot_number", "FrameNo", "PositionY", "PositionX"),
}


def _ranged(df: DataFrame, name: str) -> DataFrame:
    """Rows of a lot in few files, so that a lot filter prunes files by their statistics."""
    return df.repartitionByRange(*_SORT[name][:2]).sortWithinPartitions(*[
        F.col(c).asc_nulls_last() for c in _SORT[name]])


def build_bundle(judged: DataFrame, out_dir: str, *, bit_items: tuple[str, ...] | list[str],
                 bins: int = KDE_BINS, version: str = "1") -> dict:
    """Build the grains from a judged DataFrame, write them, then publish them.

    Every build writes a folder of its own; only the manifest, renamed over the old
    one at the end, names it.  A build that fails leaves the published bundle as it was.

    ``judged`` should be a scan of the written judged stage (each grain then
    re-reads only the columns it needs); it is not cached, so nothing of
    detail size is held in memory.  The frame statistics come first: the item bounds
    of the histogram are read off them instead of the detail.
    """
    if bins < 2:
        raise ValueError("bins must be >= 2")
    check_item_names(bit_items)
    stage = dataset_stage(judged)
    if stage not in (None, "judged"):
        raise ValueError(f"bundle input must be the judged stage, got {stage!r}")
    spark = judged.sparkSession
    base, build = out_dir.rstrip("/"), f"build-{uuid.uuid4().hex}"
    counts = {}

    def written(name: str, df: DataFrame) -> DataFrame:
        obs = Observation(f"rows_{name}")
        # observed above the range exchange: its sampling job reads what is below
        (_ranged(df, name).observe(obs, F.count(F.lit(1)).alias("rows"))
         .write.options(**parquet_options(df)).parquet(f"{base}/{build}/{name}"))
        counts[name] = int(obs.get["rows"])
        return spark.read.schema(df.schema).parquet(f"{base}/{build}/{name}")

    try:
        frame_stats = written("frame_item_stats", A.frame_item_stats(judged))
        written("lots", A.lots(judged))
        written("position_item_stats", A.position_item_stats(judged))
        written("lot_item_histogram", A.lot_item_histogram(judged, bins, A.item_bounds_of(frame_stats)))
        written("piece_ng", A.piece_ng(judged, bit_items))
    except BaseException:
        remove_folder(spark, f"{base}/{build}")
        raise
    tables = {n: {"path": f"{build}/{n}", "rows": counts[n]} for n in BUNDLE_TABLES}
    return publish(spark, base, tables, bit_items=bit_items, bins=bins, version=version)


def remove_old_builds(spark: SparkSession, bundle_dir: str) -> list[str]:
    """Remove all builds but those that the manifest names (old ones, and what a killed build has left).

    To be called by the bundle's owner when no reader uses an older build any more and no build is under way.
    Returns the names of what was removed."""
    base = bundle_dir.rstrip("/")
    tables = json.loads(read_text(spark, f"{base}/manifest.json"))["tables"].values()
    named = {m["path"].split("/")[0] for t in tables for m in t.get("days", {"": t}).values()}
    old = [f for f in folders(spark, base) if f.startswith("build-") and f not in named]
    for f in old:
        remove_folder(spark, f"{base}/{f}")
    return old


def publish(spark: SparkSession, base: str, tables: dict[str, dict], *,
            bit_items: tuple[str, ...] | list[str], bins: int, version: str = "1") -> dict:
    """Point the bundle's manifest at ``tables``: per name its rows and path, or a path per start date."""
    manifest = {
        "dataset_stage": "analysis",
        "dataset_version": version,
        "aggregation_filter": "is_judgement_target (all tables but lots)",
        "kde_bins": bins,
        "tables": tables,
        "ng_bit_mapping": [{"colname": c, "bit_index": i, "bit_value": 1 << i}
                           for i, c in enumerate(bit_items)],
    }
    write_text_atomic(spark, f"{base}/manifest.json", json.dumps(manifest, ensure_ascii=False, indent=2))
    return manifest


def open_bundle(spark: SparkSession, bundle_dir: str) -> dict:
    """Read a published bundle: ``{"manifest": dict, <table>: DataFrame, ...}``, under the contract's types."""
    base = bundle_dir.rstrip("/")
    manifest = json.loads(read_text(spark, f"{base}/manifest.json"))
    out: dict = {"manifest": manifest, "kde_bins": manifest["kde_bins"],
                 "bit_items": tuple(m["colname"] for m in sorted(manifest["ng_bit_mapping"],
                                                                  key=lambda m: m["bit_index"]))}
    for name, meta in manifest["tables"].items():
        paths = [f"{base}/{m['path']}" for m in meta.get("days", {"": meta}).values()]
        schema = T.StructType([T.StructField(c, T._parse_datatype_string(BUNDLE_TYPES.get(c, "double")))
                               for c in GRAIN_COLUMNS[name]])
        out[name] = read_typed(spark, paths, schema)
    return out
