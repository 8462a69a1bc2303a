"""Stages and bundles: round trips, layout, foreign files, publishing."""

import json
import re

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lotlens.contracts import RAW_SCHEMA
from lotlens.operators import aggregates as A
from lotlens.operators.frames import frame_grid, frame_value_levels, path_series
from lotlens.operators.kde import frame_kde
from lotlens.operators.rows import judge, standardize
from lotlens.plans.pipeline import aggregate, ingest, judge_stage, standardize_stage
from lotlens.plans.repository import bundle_from_judged, frame_values, lot_filter, ng_rate_by_frame
from lotlens.plans.views import fq_map
from lotlens.sources.bundle import build_bundle, open_bundle, remove_old_builds
from lotlens.sources.paths import path_catalog
from lotlens.sources.stages import (
    DICTIONARY_COLUMNS, dataset_stage, lot_days, parquet_options, read_raw, read_stage, remove_old_versions, stage_about,
    stage_folder, write_stage)
from tests.conftest import pipeline_rows

BITS = ("Scratch_v1", "Gap_v2", "Flat_v3")


def rows(df):
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=repr)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def stages(spark, pipeline_raw, tmp_path):
    n, raw = ingest(pipeline_raw, str(tmp_path / "raw"))
    m, std = standardize_stage(spark, raw, str(tmp_path / "std"))
    k, jdg = judge_stage(spark, std, str(tmp_path / "jdg"))
    assert n == m == k == 13
    return raw, std, jdg


def test_stages_keep_everything(spark, stages, pipeline_raw):
    raw, _, jdg = stages
    assert rows(read_raw(spark, raw)) == rows(pipeline_raw)
    judged = read_stage(spark, jdg, "judged")
    assert rows(judged) == rows(pipeline_raw.transform(standardize).transform(judge))
    assert {r.lot_number for r in judged.collect()} == {"L-7", "0012"}
    assert dict(judged.dtypes)["lot_number"] == "string" and dataset_stage(judged) == "judged"
    with pytest.raises(ValueError):
        judge_stage(spark, jdg, jdg + "-again")
    with pytest.raises(RuntimeError):
        write_stage(pipeline_raw, raw + "-bad", "raw", expected_rows=12)


def test_lots_that_are_folder_names_stay_text(spark, pipeline_raw, tmp_path):
    path = str(tmp_path / "by_lot")
    pipeline_raw.write.partitionBy("lot_number").parquet(path)
    assert {r.lot_number for r in read_raw(spark, path).collect()} == {"L-7", "0012"}


def test_stages_move_nothing(spark, stages):
    """From scan to write there is no exchange; the folders follow the start date."""
    raw, std, _ = stages
    for df in (read_raw(spark, raw).transform(standardize), read_raw(spark, raw).transform(standardize).transform(judge)):
        assert "Exchange" not in plan(df) and "Sort" not in plan(df)
    assert sorted(r[0].isoformat() for r in spark.read.parquet(stage_folder(spark, std)).select("start_date").distinct().collect()) \
        == ["2025-03-04", "2025-03-05"]


def test_files_of_other_writers(spark, tmp_path, pipeline_raw):
    """Nanosecond times, dictionary text, unsigned masks and floating counts are read under the contract's types."""
    schema = pa.schema([(f.name, {"string": pa.string(), "timestamp_ntz": pa.timestamp("ns"), "smallint": pa.int16(),
                                  "tinyint": pa.int8(), "double": pa.float64(), "boolean": pa.bool_()}[f.dataType.simpleString()])
                        for f in RAW_SCHEMA.fields])
    columns = dict(zip(schema.names, zip(*pipeline_rows(), strict=True), strict=True))
    table = pa.table({n: pa.array(columns[n], schema.field(n).type) for n in schema.names})
    table = table.set_column(schema.get_field_index("colname"), "colname", table["colname"].dictionary_encode())
    path = str(tmp_path / "ns.parquet")
    pq.write_table(table, path, version="2.6")
    assert rows(read_raw(spark, path)) == rows(pipeline_raw)

    base = tmp_path / "foreign"
    out = build_bundle(pipeline_raw.transform(standardize).transform(judge), str(base), bit_items=BITS, bins=4)
    table = pq.read_table(base / out["tables"]["piece_ng"]["path"])
    (base / "other").mkdir()
    table = table.set_column(table.schema.get_field_index("ng_mask"), "ng_mask", table["ng_mask"].cast(pa.uint64()))
    table = table.set_column(table.schema.get_field_index("total_item_count"), "total_item_count",
                             table["total_item_count"].cast(pa.float64()))
    pq.write_table(table.replace_schema_metadata(None), base / "other" / "piece_ng.parquet")
    manifest = json.loads((base / "manifest.json").read_text())
    manifest["tables"]["piece_ng"]["path"] = "other/piece_ng.parquet"
    (base / ".manifest.json.crc").unlink(missing_ok=True)  # of the text that is replaced here
    (base / "manifest.json").write_text(json.dumps(manifest))
    read = open_bundle(spark, str(base))["piece_ng"]
    assert {k: t for k, t in read.dtypes if k in ("ng_mask", "total_item_count", "lot_number")} == {
        "ng_mask": "bigint", "total_item_count": "bigint", "lot_number": "string"}
    assert read.agg(F.max("ng_mask")).first()[0] == 0b110


def test_bundle_round_trip(spark, stages, tmp_path):
    out = str(tmp_path / "bundle")
    judged = read_stage(spark, stages[2], "judged")
    manifest = aggregate(spark, stages[2], out, bins=4, bit_items=BITS)
    assert {n: m["rows"] for n, m in manifest["tables"].items()} == {
        "lots": 2, "frame_item_stats": 7, "position_item_stats": 12, "lot_item_histogram": 12, "piece_ng": 6}
    b = open_bundle(spark, out)
    assert b["bit_items"] == BITS and b["kde_bins"] == 4
    for name, built in (("lots", A.lots(judged)), ("frame_item_stats", A.frame_item_stats(judged)),
                        ("position_item_stats", A.position_item_stats(judged)),
                        ("lot_item_histogram", A.lot_item_histogram(judged, 4)), ("piece_ng", A.piece_ng(judged, BITS))):
        assert rows(b[name]) == rows(built), name
    with pytest.raises(FileNotFoundError):
        open_bundle(spark, str(tmp_path / "missing"))
    with pytest.raises(ValueError):
        build_bundle(judged, out, bit_items=BITS, bins=1)


def test_failed_rebuild_leaves_the_published_bundle(spark, pipeline_raw, tmp_path):
    out = str(tmp_path / "bundle")
    judged = pipeline_raw.transform(standardize).transform(judge)
    build_bundle(judged, out, bit_items=BITS, bins=4)
    before = {n: rows(open_bundle(spark, out)[n]) for n in ("lots", "frame_item_stats", "piece_ng")}
    fails = judged.filter("lot_number = 'L-7'").withColumn(
        "is_ng", F.when(F.col("colname") == "Gap_v2", F.raise_error(F.lit("planted"))).otherwise(F.col("is_ng")))
    with pytest.raises(Exception, match="planted"):
        build_bundle(fails, out, bit_items=BITS, bins=4)
    assert {n: rows(open_bundle(spark, out)[n]) for n in before} == before
    build_bundle(judged.filter("lot_number = 'L-7'"), out, bit_items=BITS, bins=4)
    assert open_bundle(spark, out)["lots"].count() == 1


def names(path):
    return sorted(p.name for p in path.iterdir() if not p.name.startswith("."))


def test_failed_rewrite_leaves_the_published_stage(spark, stages, pipeline_raw, tmp_path):
    """A stage is replaced whole or not at all, and a failed write leaves nothing behind."""
    std, before = tmp_path / "std", rows(read_stage(spark, stages[1], "standardized"))
    version = stage_about(spark, stages[1])["path"]
    fails = pipeline_raw.transform(standardize).withColumn(
        "spec_usage", F.when(F.col("lot_number") == "L-7", F.raise_error(F.lit("planted")).cast("double")).otherwise(F.col("spec_usage")))
    with pytest.raises(Exception, match="planted"):
        write_stage(fails, stages[1], "standardized")
    assert names(std) == ["stage.json", version]
    assert rows(read_stage(spark, stages[1], "standardized")) == before
    with pytest.raises(RuntimeError, match="expected 12"):
        write_stage(pipeline_raw.transform(standardize), stages[1], "standardized", expected_rows=12)
    assert names(std) == ["stage.json", version]
    write_stage(pipeline_raw.filter("lot_number = 'L-7'").transform(standardize), stages[1], "standardized", expected_rows=3)
    assert read_stage(spark, stages[1], "standardized").count() == 3


def test_rows_that_do_not_match_are_not_published(spark, pipeline_raw, tmp_path, monkeypatch):
    from lotlens.sources import stages as S
    with pytest.raises(RuntimeError, match="wrote 13 rows, expected 12"):
        write_stage(pipeline_raw, str(tmp_path / "short"), "raw", expected_rows=12)
    monkeypatch.setattr(S, "stored_counts", lambda spark, folder: {"rows": 11, "files": 1, "bytes": 1})
    with pytest.raises(RuntimeError, match="the files hold 11"):
        write_stage(pipeline_raw, str(tmp_path / "short"), "raw")
    assert names(tmp_path / "short") == [] and stage_about(spark, str(tmp_path / "short")) is None


def test_stage_metadata(spark, stages, pipeline_raw, tmp_path):
    about = stage_about(spark, stages[2])
    files = [p for p in (tmp_path / "jdg" / about["path"] / "rows").rglob("*.parquet")]
    assert (about["dataset_stage"], about["rows"], about["files"]) == ("judged", 13, len(files))
    assert about["bytes"] == sum(p.stat().st_size for p in files)
    assert sorted((r.lot_number, r.start_date.isoformat(), r["rows"]) for r in lot_days(spark, stages[2]).collect()) \
        == [("0012", "2025-03-05", 10), ("L-7", "2025-03-04", 3)]
    with pytest.raises(ValueError, match="no published judged stage"):
        lot_days(spark, stages[0])
    assert write_stage(pipeline_raw.limit(0), str(tmp_path / "none"), "raw") == 0
    assert read_stage(spark, str(tmp_path / "none"), "raw").columns == [f.name for f in RAW_SCHEMA.fields]


def test_old_versions_go_when_asked(spark, stages, pipeline_raw, tmp_path):
    old = stage_about(spark, stages[0])["path"]
    ingest(pipeline_raw, stages[0])
    (tmp_path / "raw" / "v-killed").mkdir()
    assert remove_old_versions(spark, stages[0]) == sorted([old, "v-killed"])
    assert names(tmp_path / "raw") == ["stage.json", stage_about(spark, stages[0])["path"]]
    assert read_raw(spark, stages[0]).count() == 13

    out, judged = str(tmp_path / "bundle"), read_stage(spark, stages[2], "judged")
    builds = [build_bundle(judged, out, bit_items=BITS, bins=4)["tables"]["lots"]["path"].split("/")[0] for _ in range(2)]
    assert remove_old_builds(spark, out) == [builds[0]]
    assert open_bundle(spark, out)["lots"].count() == 2 and names(tmp_path / "bundle") == sorted([builds[1], "manifest.json"])


def test_writer_settings(spark, pipeline_raw, tmp_path):
    """Zstd pages, dictionaries for the text columns alone, row groups of the asked size."""
    many = pipeline_raw.crossJoin(spark.range(4000)).withColumn("value", F.rand(3)).drop("id").coalesce(1)
    write_stage(many, str(tmp_path / "s"), "raw", row_group_bytes=1 << 16)
    meta = pq.read_metadata(max((tmp_path / "s").rglob("*.parquet"), key=lambda p: p.stat().st_size))
    assert meta.num_row_groups > 3
    coded = {}
    for k in range(meta.num_columns):
        column = meta.row_group(0).column(k)
        assert column.compression == "ZSTD"
        coded[column.path_in_schema] = any("DICTIONARY" in e for e in column.encodings)
    assert {c for c, d in coded.items() if d} == set(DICTIONARY_COLUMNS)
    assert parquet_options(many)["parquet.compression.codec.zstd.level"] == "6"


def partition_filters(df):
    return re.search(r"PartitionFilters: \[(.*?)\]", plan(df))[1]


def test_point_lookup_reads_one_folder(spark, stages):
    judged, days = read_stage(spark, stages[2], "judged", dated=True), lot_days(spark, stages[2])
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    try:
        for found in (frame_values(judged, "0012", 3, "Gap_v2", days),
                      frame_grid(judged.withColumn("measure_id", F.lit(1)), "0012", 3, "Gap_v2", days=days)):
            assert "start_date" in partition_filters(found) and "2025-03-05" in partition_filters(found)
            for pushed in ("EqualTo(lot_number,0012)", "EqualTo(FrameNo,3)", "EqualTo(colname,Gap_v2)"):
                assert pushed in plan(found), plan(found)
        assert partition_filters(frame_values(judged, "0012", 3, "Gap_v2")) == ""
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    cells = frame_values(judged, "0012", 3, "Gap_v2", days).collect()
    assert cells == frame_values(judged, "0012", 3, "Gap_v2").collect() and len(cells) == 3
    grid = frame_grid(judged.withColumn("measure_id", F.lit(1)), "0012", 3, "Gap_v2", days=days).collect()
    assert len(grid) == 288
    assert sorted((r.PositionX, r.ng_direction) for r in grid if r.value is not None) == [(2, 0), (7, 1), (24, 0)]
    assert frame_values(judged, "no such lot", 3, "Gap_v2", days).count() == 0


def test_lots_given_as_a_table(spark, stages, tmp_path):
    """A table of lots selects like a list, and its dates prune the stage's folders while the query runs."""
    judged, days = read_stage(spark, stages[2], "judged", dated=True), lot_days(spark, stages[2])
    chosen = lot_filter(judged, days.filter("lot_number LIKE 'L%'"))
    assert rows(chosen) == rows(lot_filter(judged, ["L-7"]))
    assert "dynamicpruning" in partition_filters(chosen)
    assert lot_filter(judged, days.limit(0)).count() == 0
    b = bundle_from_judged(judged, BITS, 4)
    named = b["lots"].filter("lot_number = '0012'").select("lot_number")
    assert rows(ng_rate_by_frame(b, named)) == rows(ng_rate_by_frame(b, ["0012"]))
    assert rows(fq_map(b, BITS, lots=named)) == rows(fq_map(b, BITS, lots=["0012"]))


def test_detail_moves_once(spark, stages):
    """Frame views, position statistics and the histogram have one exchange, and no sorted aggregate."""
    judged = read_stage(spark, stages[2], "judged").withColumn("measure_id", F.lit(1))
    grid = frame_grid(judged)
    for df in (grid, frame_kde(judged), frame_value_levels(judged), path_series(grid, path_catalog(spark)),
               A.lot_item_histogram(judged, 4), A.position_item_stats(judged)):
        assert len(re.findall(r"Exchange hashpartitioning\(lot_number", plan(df))) == 1, plan(df)
        assert "SortAggregate" not in plan(df), plan(df)
