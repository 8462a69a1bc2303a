"""Streaming pipeline equals the batch grains, across several micro-batches."""

import datetime

import pytest
from pyspark.sql import functions as F

from lotlens.contracts import RAW_SCHEMA
from lotlens.operators import aggregates as A
from lotlens.operators.rows import judge, standardize
from lotlens.sources.bundle import open_bundle
from lotlens.streaming.judge_stream import (
    grain_refresher, judged_stream, refresh_histogram, remove_old_batches, start_pipeline, touched_detail)
from tests.conftest import pipeline_rows

BITS = ("Scratch_v1", "Gap_v2", "Flat_v3")


def rows(df, columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_stream_matches_batch(spark, tmp_path):
    measured = pipeline_rows()
    landing = tmp_path / "landing"
    landing.mkdir()
    # three micro-batches; the lots come in pieces
    for k, part in enumerate((measured[:4], measured[4:9], measured[9:])):
        spark.createDataFrame(part, RAW_SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"f{k}"))
        for f in (tmp_path / f"f{k}").glob("*.parquet"):
            (landing / f"part{k}.parquet").write_bytes(f.read_bytes())
    judged_dir, bundle_dir = str(tmp_path / "judged"), str(tmp_path / "bundle")
    q = (judged_stream(spark, str(landing), max_files_per_trigger=1).writeStream
         .foreachBatch(grain_refresher(judged_dir, bundle_dir, BITS, 4))
         .option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start())
    q.awaitTermination(120)
    assert q.exception() is None
    batch = spark.createDataFrame(measured, RAW_SCHEMA).transform(standardize).transform(judge)
    refresh_histogram(spark, judged_dir, bundle_dir, BITS, 4)

    def check():
        b = open_bundle(spark, bundle_dir)
        for name, built in (("lots", A.lots(batch)), ("frame_item_stats", A.frame_item_stats(batch)),
                            ("position_item_stats", A.position_item_stats(batch)), ("piece_ng", A.piece_ng(batch, BITS)),
                            ("lot_item_histogram", A.lot_item_histogram(batch, 4))):
            assert rows(b[name], built.columns) == rows(built, built.columns), name
            assert b["manifest"]["tables"][name]["rows"] == built.count()

    check()
    # a second run finds nothing new and leaves the results unchanged
    again = start_pipeline(spark, str(landing), judged_dir, bundle_dir, str(tmp_path / "ckpt"), BITS)
    again.awaitTermination(120)
    check()


def test_a_reader_sees_one_batch_whole(spark, tmp_path):
    """What was opened before a batch stays as it was; a failing batch publishes nothing; old folders go when asked."""
    judged_dir, bundle_dir = str(tmp_path / "judged"), str(tmp_path / "bundle")
    refresh = grain_refresher(judged_dir, bundle_dir, BITS, 4)
    measured = spark.createDataFrame(pipeline_rows(), RAW_SCHEMA).transform(standardize).transform(judge)
    refresh(measured.filter("lot_number = 'L-7' OR colname = 'Gap_v2'"), 0)
    opened = open_bundle(spark, bundle_dir)
    before = {n: rows(opened[n], opened[n].columns) for n in ("lots", "frame_item_stats", "piece_ng")}
    refresh(measured.filter("lot_number <> 'L-7' AND colname <> 'Gap_v2'"), 1)
    assert {n: rows(opened[n], opened[n].columns) for n in before} == before
    after = open_bundle(spark, bundle_dir)
    assert rows(after["frame_item_stats"], ["lot_number", "colname", "total_count"]) \
        == rows(A.frame_item_stats(measured), ["lot_number", "colname", "total_count"])
    assert after["manifest"]["tables"]["piece_ng"]["rows"] == A.piece_ng(measured, BITS).count()
    fails = measured.filter("lot_number <> 'L-7'").withColumn(
        "is_ng", F.when(F.col("is_ng"), F.raise_error(F.lit("planted")).cast("boolean")).otherwise(F.col("is_ng")))
    with pytest.raises(Exception, match="planted"):
        refresh(fails, 2)
    assert open_bundle(spark, bundle_dir)["manifest"] == after["manifest"]
    refresh(measured.filter("lot_number <> 'L-7' AND colname <> 'Gap_v2'"), 1)  # replayed
    again = open_bundle(spark, bundle_dir)
    assert again["manifest"] != after["manifest"]
    assert rows(again["piece_ng"], again["piece_ng"].columns) == rows(after["piece_ng"], after["piece_ng"].columns)
    assert len(remove_old_batches(spark, bundle_dir)) == 1 and remove_old_batches(spark, bundle_dir) == []
    assert rows(open_bundle(spark, bundle_dir)["lots"], ["lot_number"]) == [("0012",), ("L-7",)]


def test_a_batch_reads_its_days_only(spark, tmp_path):
    judged_dir = str(tmp_path / "judged")
    refresh = grain_refresher(judged_dir, str(tmp_path / "bundle"), BITS, 4)
    refresh(spark.createDataFrame(pipeline_rows(), RAW_SCHEMA).transform(standardize).transform(judge), 0)
    detail = touched_detail(spark, judged_dir, [datetime.date(2025, 3, 4)])
    scan = detail._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(start_date" in scan and "2025-03-04" in scan.split("PartitionFilters")[1][:120]
    assert {r.lot_number for r in detail.collect()} == {"L-7"}
