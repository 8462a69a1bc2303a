"""Stage-level jobs over Parquet folders: raw -> standardized -> judged -> bundle.

Each job reads its input stage under the stage's schema, writes its output
stage in one projection and returns ``(rows, output_path)``; the output is
only published when the rows read, written and stored are as many.
Input/output paths are shared storage (HDFS / object store) on a cluster.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lotlens.contracts import KDE_BINS
from lotlens.operators.rows import judge, standardize
from lotlens.sources.bundle import build_bundle
from lotlens.sources.item_orders import SPEC_ORDER
from lotlens.sources.stages import lay_out, read_stage, write_stage


def _stage(source: DataFrame, stage: str, path: str, step: Callable[[DataFrame], DataFrame]) -> int:
    """One projection from scan to write: no shuffle, rows counted on both ends of the same job."""
    seen = Observation(f"input_{stage}")
    counted = source.observe(seen, F.count(F.lit(1)).alias("rows"))
    return write_stage(counted.transform(step), path, stage, expected_rows=seen)


def ingest(raw: DataFrame, output_path: str) -> tuple[int, str]:
    """Raw measurements -> raw stage, laid out by start and lot once for all later stages."""
    return write_stage(lay_out(raw), output_path, "raw"), output_path


def standardize_stage(spark: SparkSession, input_path: str, output_path: str) -> tuple[int, str]:
    """raw Parquet -> standardized Parquet (same layout)."""
    raw = read_stage(spark, input_path, "raw")
    return _stage(raw, "standardized", output_path, standardize), output_path


def judge_stage(spark: SparkSession, input_path: str, output_path: str) -> tuple[int, str]:
    """standardized Parquet -> judged Parquet (same layout)."""
    std = read_stage(spark, input_path, "standardized")
    return _stage(std, "judged", output_path, judge), output_path


def aggregate(spark: SparkSession, input_path: str, output_dir: str, bins: int = KDE_BINS,
              bit_items: tuple[str, ...] = SPEC_ORDER) -> dict:
    """judged Parquet -> analysis bundle (5 tables + manifest, manifest last)."""
    judged = read_stage(spark, input_path, "judged")
    return build_bundle(judged, output_dir, bit_items=bit_items, bins=bins)
