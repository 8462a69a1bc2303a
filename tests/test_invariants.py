"""Data-independent invariants: scalar rules, KDE integral, display ranges, codecs."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotlens.contracts import RAW_SCHEMA
from lotlens.functions.scalar import gaussian_kernel, nice_upper, spec_display_range
from lotlens.operators import aggregates as A
from lotlens.operators import kde as K
from lotlens.operators.rows import judge, standardize
from lotlens.plans import repository as R
from lotlens.plans import views as V
from tests.conftest import raw_row

T0 = datetime(2026, 1, 1)


def test_nice_upper(spark):
    df = spark.createDataFrame([(0.278, 0.1), (1.2, 0.1), (0.0, 1.0), (-3.0, 0.1), (7.0, 1.0), (None, 1.0)],
                               "x double, m double")
    got = [r.y for r in df.select(
        F.when(F.col("m") == 0.1, nice_upper(F.col("x"), 0.1)).otherwise(nice_upper(F.col("x"), 1.0))
        .alias("y")).collect()]
    assert got[0] == pytest.approx(0.3) and got[1] == pytest.approx(2.0)
    assert got[2] == 1.0 and got[3] == 0.1 and got[4] == pytest.approx(10.0) and got[5] is None


def test_column_codec(spark):
    df = spark.createDataFrame([(c,) for c in (0, 23, 24, 191, 192, 2399)], "c int")
    lot, frame = V.column_to_lot_frame(F.col("c"))
    got = [(r.l, r.f) for r in df.select(lot.alias("l"), frame.alias("f")).collect()]
    assert got == [(0, 1), (0, 24), (1, 1), (7, 24), (8, 1), (99, 24)]
    back = df.select(V.column_position(lot, frame).alias("c2")).collect()
    assert [r.c2 for r in back] == [0, 23, 24, 191, 192, 2399]


def test_display_range_cases(spark):
    df = spark.createDataFrame([(3.9, 4.1, None), (None, 0.3, 0.0)], "l double, u double, b double")
    lo, hi = spec_display_range(F.col("l"), F.col("u"), F.col("b"), F.lit(0.0), F.lit(1.0))
    r = df.select(lo.alias("lo"), hi.alias("hi")).collect()
    assert (r[0].lo, r[0].hi) == pytest.approx((3.85, 4.15))
    assert (r[1].lo, r[1].hi) == pytest.approx((0.0, 0.36))
    # two-sided: limits at 1/6 and 5/6 of the range, centre at 1/2
    span = r[0].hi - r[0].lo
    assert (3.9 - r[0].lo) / span == pytest.approx(1 / 6)
    assert (4.1 - r[0].lo) / span == pytest.approx(5 / 6)
    # upper + best: upper at 5/6
    assert (0.3 - r[1].lo) / (r[1].hi - r[1].lo) == pytest.approx(5 / 6)


def test_kernel():
    k = gaussian_kernel(1.5)
    assert len(k) == 13 and sum(k) == pytest.approx(1.0) and k[6] == max(k)


def _spread_rows(n_lots=3):
    rows = []
    for li in range(n_lots):
        lot = f"LOT_{li}"
        for frame in (1, 2):
            for x in range(1, 25):
                for y in range(1, 4):
                    v = ((x * 7 + y * 13 + frame * 3 + li) % 50) / 10.0 - 0.5
                    rows.append(raw_row(lot, T0.replace(day=li + 1), frame, x, y, v, "A_v1", 0.0, 4.0, None))
                    rows.append(raw_row(lot, T0.replace(day=li + 1), frame, x, y, abs(v) * 0.1, "B_v1", None,
                                        0.3, 0.0, category="foreign"))
    return rows


def test_kde_integral_equals_coverage(spark):
    raw = spark.createDataFrame(_spread_rows(), RAW_SCHEMA)
    j = raw.transform(standardize).transform(judge)
    b = R.bundle_from_judged(j, ("A_v1", "B_v1"), 60)
    kde = K.lot_kde(b, ("A_v1", "B_v1"))
    width = (F.col("x") - F.lag("x").over(
        __import__("pyspark.sql", fromlist=["Window"]).Window.partitionBy("colname", "lot_number").orderBy("bin_index")))
    check = kde.withColumn("w", width).groupBy("colname", "lot_number").agg(
        (F.sum(F.col("density")) * F.max("w")).alias("integral"),
        F.first((F.col("in_range_count") / F.col("sample_count"))).alias("coverage"))
    for r in check.collect():
        assert r.integral == pytest.approx(r.coverage, abs=1e-9)
    fk = K.frame_kde(j)
    fcheck = fk.groupBy("lot_number", "FrameNo", "colname").agg(
        (F.sum("density") * (F.first("display_max") - F.first("display_min")) / 60).alias("integral"),
        F.first(F.col("in_range_count") / F.col("sample_count")).alias("coverage"))
    for r in fcheck.collect():
        assert r.integral == pytest.approx(r.coverage, abs=1e-9)


def test_kde_against_numpy(spark):
    np = pytest.importorskip("numpy")
    raw = spark.createDataFrame(_spread_rows(1), RAW_SCHEMA)
    j = raw.transform(standardize).transform(judge)
    fk = K.frame_kde(j).filter((F.col("FrameNo") == 1) & (F.col("colname") == "A_v1")).orderBy("bin_index")
    got = [r.density for r in fk.collect()]
    vals = np.array([r.value for r in j.filter((F.col("FrameNo") == 1) & (F.col("colname") == "A_v1")).collect()])
    lo, hi = 0.0 - 1.0, 4.0 + 1.0
    edges = np.linspace(lo, hi, 61)
    inr = vals[(vals >= lo) & (vals <= hi)]
    counts, _ = np.histogram(inr, bins=edges)
    k = np.array(gaussian_kernel(1.5))
    sm = np.convolve(np.pad(counts, (6, 6)), k[::-1], mode="valid")
    dens = sm / sm.sum() * len(inr) / len(vals) / (edges[1] - edges[0])
    assert got == pytest.approx(list(dens), abs=1e-12)


def test_quantiles_monotone_and_reconcile(spark):
    from lotlens.operators import checks as C
    raw = spark.createDataFrame(_spread_rows(), RAW_SCHEMA)
    j = raw.transform(standardize).transform(judge)
    fs = A.frame_item_stats(j)
    assert all(r.ok for r in C.quantile_monotone(fs).collect())
    assert all(r.ok for r in C.source_reconcile(j, fs).collect())
    assert all(r.ok for r in C.unit_consistency(j).collect())
    assert all(r.complete is False for r in C.frame_completeness(j).collect())


def test_spec_shapes(spark):
    rows = [
        raw_row("L", T0, 1, 1, 1, 2.0, "two_v1", 0.0, 10.0, None),
        raw_row("L", T0, 1, 1, 1, 2.0, "up_v1", None, 10.0, 4.0),
        raw_row("L", T0, 1, 1, 1, 1.0, "lo_v1", 2.0, None, 5.0),
        raw_row("L", T0, 1, 1, 1, 11.0, "uponly_v1", None, 10.0, None),
        raw_row("L", T0, 1, 1, 1, float("nan"), "nan_v1", 0.0, 10.0, None),
        raw_row("L", T0, 1, 1, 1, 5.0, "zero_v1", 5.0, 5.0, None),
        raw_row("L", T0, 1, 1, 1, 5.0, "aux_v1", 0.0, 1.0, None, meta_type="aux"),
        raw_row("L", T0, 1, 1, 1, 5.0, "ign_v1", 0.0, 1.0, None, ignore=True),
    ]
    j = {r.colname: r for r in spark.createDataFrame(rows, RAW_SCHEMA).transform(standardize).transform(judge)
         .collect()}
    assert j["two_v1"].spec_usage is None and j["two_v1"].spec_position == pytest.approx(-0.6)
    assert j["up_v1"].spec_position is None and j["up_v1"].spec_usage == pytest.approx(-1 / 3)
    assert j["up_v1"].normalized_deviation == 0.0
    assert j["lo_v1"].normalized_value is None and j["lo_v1"].is_ng and j["lo_v1"].ng_direction == -1
    assert j["uponly_v1"].normalized_value is None and j["uponly_v1"].ng_direction == 1
    assert not j["nan_v1"].is_ng and j["nan_v1"].spec_position is None
    assert j["zero_v1"].spec_position is None and not j["zero_v1"].is_ng
    assert not j["aux_v1"].is_judgement_target and not j["aux_v1"].is_ng
    assert not j["ign_v1"].is_judgement_target


def test_edge_grains(spark):
    rows = [
        raw_row("AUX", T0, 1, 1, 1, 5.0, "aux_v1", 0.0, 1.0, None, meta_type="aux"),
        raw_row("L", T0.replace(day=2), 1, 1, 1, 5.0, "known_v1", 0.0, 1.0, None),
        raw_row("L", T0.replace(day=2), 1, 1, 1, 5.0, "stranger_v1", 0.0, 1.0, None),
        raw_row("L", T0.replace(day=2), 1, 2, 1, None, "known_v1", 0.0, 10.0, None),
    ]
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in RAW_SCHEMA.fields])
    j = spark.createDataFrame(rows, schema).transform(standardize).transform(judge)
    assert sorted(r.lot_number for r in A.lots(j).collect()) == ["AUX", "L"]
    assert A.frame_item_stats(j).filter("lot_number = 'AUX'").count() == 0
    p = A.piece_ng(j, ("known_v1",)).filter("PositionX = 1").first()
    assert p.ng_item_count == 2 and p.ng_mask == 1 and p.is_ng
    p2 = A.piece_ng(j, ("other_v1",)).filter("PositionX = 1").first()
    assert p2.ng_item_count == 2 and p2.ng_mask == 0 and not p2.is_ng
    fs = A.frame_item_stats(j).filter("colname = 'known_v1'").first()
    assert fs.total_count == 2 and fs.sample_count == 1
    h = A.lot_item_histogram(j, 4).filter("colname = 'known_v1'")
    assert h.filter("bin_index IS NULL").agg(F.sum("count")).first()[0] == 1


def test_lot_kde_absent_item_is_null(spark):
    rows = [raw_row("L1", T0, 1, 1, 1, 1.0, "a_v1", 0.0, 4.0, None),
            raw_row("L1", T0, 1, 1, 1, 1.0, "b_v1", 0.0, 4.0, None),
            raw_row("L2", T0.replace(day=2), 1, 1, 1, 2.0, "a_v1", 0.0, 4.0, None)]
    j = spark.createDataFrame(rows, RAW_SCHEMA).transform(standardize).transform(judge)
    b = R.bundle_from_judged(j, ("a_v1", "b_v1"), 60)
    kde = K.lot_kde(b, ("a_v1", "b_v1"))
    assert kde.count() == 2 * 2 * 60
    assert kde.filter("colname = 'b_v1' AND lot_number = 'L2'").filter(F.col("density").isNotNull()).count() == 0
    one = kde.filter("colname = 'a_v1' AND lot_number = 'L1'")
    width = 6.0 / 60  # limits 0..4, a quarter of the span on each side
    assert one.agg(F.sum("density")).first()[0] * width == pytest.approx(1.0)
    assert one.orderBy(F.desc("density")).first().x == pytest.approx(1.0, abs=width)


def test_zero_width_display_range_spares_other_items(spark):
    """One item whose best value is its upper limit has no density; the others keep theirs."""
    rows = [raw_row("L1", T0, 1, x, 1, 1.0 + x, "good_v1", 0.0, 9.0, None) for x in (1, 2, 3)]
    rows += [raw_row("L1", T0, 1, 1, 1, 5.0, "point_v1", None, 5.0, 5.0)]
    j = spark.createDataFrame(rows, RAW_SCHEMA).transform(standardize).transform(judge).withColumn("measure_id", F.lit(1))
    known = ("good_v1", "point_v1")
    b = R.bundle_from_judged(j, known, 60)
    for kde in (K.lot_kde(b, known), K.frame_kde(j)):
        assert kde.filter("colname = 'point_v1' AND density IS NOT NULL").count() == 0
        assert kde.filter("colname = 'good_v1' AND density > 0").count() > 5
    assert K.kde_context(b, known).filter("colname = 'good_v1' AND y_max >= 1").count() == 1
    assert b["lot_item_histogram"].filter("colname = 'point_v1' AND bin_index IS NULL").count() == 1


def test_empty_selection(spark):
    from lotlens.contracts import ItemSpec
    from lotlens.operators.frames import frame_grid
    j = spark.createDataFrame([raw_row("L1", T0, 1, 1, 1, 1.0, "a_v1", 0.0, 4.0, None)], RAW_SCHEMA) \
        .transform(standardize).transform(judge)
    b = R.bundle_from_judged(j, ("a_v1",), 60)
    item = ItemSpec("a_v1", 0.0, 4.0, None, meta_category="cat")
    r = V.dashboard_summary(b, (item,), lots=["none"]).first()
    assert (r.lot_count, r.item_count, r.total_pieces, r.piece_yield) == (0, 0, 0, None)
    assert V.fq_map(b, ("a_v1",), lots=["none"]).count() == 0
    with pytest.raises(ValueError, match="no items"):
        V.fq_map(b, ("a_v1",), lots=["none"], required=True)
    with pytest.raises(ValueError, match="no measurements"):
        frame_grid(j, lot="none", required=True)


def test_dashboard_counts_all_lots_under_an_item_filter(spark):
    from lotlens.contracts import ItemSpec
    rows = [raw_row("L1", T0, 1, 1, 1, 1.0, "a_v1", 0.0, 4.0, None, category="x"),
            raw_row("L2", T0.replace(day=3), 1, 1, 1, 1.0, "b_v1", 0.0, 4.0, None, category="y")]
    j = spark.createDataFrame(rows, RAW_SCHEMA).transform(standardize).transform(judge)
    items = (ItemSpec("a_v1", 0.0, 4.0, None, meta_category="x"), ItemSpec("b_v1", 0.0, 4.0, None, meta_category="y"))
    r = V.dashboard_summary(R.bundle_from_judged(j, ("a_v1", "b_v1"), 60), items, category="x").first()
    assert (r.lot_count, r.item_count, r.total_measurements) == (2, 1, 1)


def test_more_items_than_bits(spark):
    names = [f"i{k}_v1" for k in range(64)]
    j = spark.createDataFrame([raw_row("L1", T0, 1, 1, 1, 1.0, names[0], 0.0, 4.0, None)], RAW_SCHEMA) \
        .transform(standardize).transform(judge)
    with pytest.raises(ValueError, match="at most 63"):
        A.piece_ng(j, names)
    with pytest.raises(ValueError, match="at most 63"):
        V.item_attributes(A.frame_item_stats(j), tuple(names))


def test_item_bounds_are_checked_before_they_are_broadcast(spark, monkeypatch):
    from lotlens.operators import aggregates
    rows = [raw_row("L1", T0, 1, 1, 1, 1.0, f"i{k}_v1", 0.0, 4.0, None) for k in range(5)]
    j = spark.createDataFrame(rows, RAW_SCHEMA).transform(standardize).transform(judge)
    assert A.lot_item_histogram(j, 4).count() == 5
    assert sorted(map(tuple, A.item_bounds_of(A.frame_item_stats(j)).collect())) == sorted(map(tuple, A.item_bounds(j).collect()))
    monkeypatch.setattr(aggregates, "MAX_ITEMS", 4)
    with pytest.raises(Exception, match="more than 4 items"):
        A.lot_item_histogram(j, 4).collect()


def test_unknown_item_stops_the_melt(spark):
    from lotlens.contracts import ItemSpec
    from lotlens.sources.raw import attach_items, clean_values
    long = spark.createDataFrame([("a_v1", 1.0), ("stranger_v1", 2.0)], "colname string, value double")
    item = ItemSpec("a_v1", 0.0, 4.0, None, meta_category="n")
    with pytest.raises(Exception, match="stranger_v1"):
        attach_items(long, spark, (item,)).collect()
    with pytest.raises(Exception, match="stranger_v1"):  # also under a filter that only known items pass
        attach_items(long, spark, (item,)).filter("meta_type = 'spec'").groupBy("colname").count().collect()
    known = attach_items(long.filter("colname = 'a_v1'"), spark, (item,))
    assert known.count() == 1
    odd = known.withColumn("value", F.lit(-0.12345))
    assert clean_values(odd, ("n",)).first().value == 0.0
    assert clean_values(odd, ()).first().value == pytest.approx(-0.1234)


def test_cells_measured_twice_need_an_order(spark):
    rows = [raw_row("L1", T0, 1, 1, 1, v, "a_v1", 0.0, 4.0, None) for v in (3.0, 1.0)]
    j = spark.createDataFrame(rows, RAW_SCHEMA).transform(standardize).transform(judge)
    with pytest.raises(Exception, match="measured twice"):
        K.frames(j).collect()
    one = K.frames(j.withColumn("measure_id", F.when(F.col("value") == 3.0, 1).otherwise(2))).first()
    assert [c.value for c in one.cells] == [3.0] and one.row_count == 2


def test_lots_are_numbered_across_days(spark):
    from datetime import timedelta

    from lotlens.operators.densify import indexed_lots
    lots = [(f"L{k:02d}", T0 + timedelta(hours=7 * k)) for k in range(20)] + [("same", T0)]
    got = indexed_lots(spark.createDataFrame(lots[::-1], "lot_number string, lot_start_time timestamp_ntz"))
    expected = {lot: k for k, (start, lot) in enumerate(sorted((s, n) for n, s in lots))}
    assert {r.lot_number: r.lot_index for r in got.collect()} == expected
    window = V.lot_window(got.select("lot_number", "lot_start_time"), visible=3)
    assert sorted(r.lot_index for r in window.collect()) == [18, 19, 20]


def test_planning_runs_no_job(spark):
    """Queries are declared without looking at the data."""
    rows = [raw_row("L1", T0, 1, x, 1, 1.0 * x, "a_v1", 0.0, 4.0, None) for x in (1, 2)]
    j = spark.createDataFrame(rows, RAW_SCHEMA).transform(standardize).transform(judge).withColumn("measure_id", F.lit(1))
    b = R.bundle_from_judged(j, ("a_v1",), 60)
    tracker = spark.sparkContext.statusTracker()
    group = "planning-only"
    spark.sparkContext.setJobGroup(group, "plans without jobs")
    try:
        plans = [V.fq_map(b, ("a_v1",)), V.quality_trend(b, ("a_v1",)), K.lot_kde(b, ("a_v1",)), K.kde_context(b, ("a_v1",)),
                 K.frame_kde(j), b["lot_item_histogram"], b["piece_ng"], V.lot_window(b["lots"])]
        assert len(plans) == 8 and not tracker.getJobIdsForGroup(group)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
