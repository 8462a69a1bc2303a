"""End-to-end on the hand fixture (13 rows, hand-computed expectations)."""

import pytest
from pyspark.sql import functions as F

from lotlens.operators import aggregates as A
from lotlens.operators.rows import judge, standardize
from lotlens.plans import repository as R
from lotlens.plans import views as V

BITS = ("Scratch_v1", "Gap_v2", "Flat_v3")


@pytest.fixture()
def judged(pipeline_raw):
    return pipeline_raw.transform(standardize).transform(judge)


def only(df, **keys):
    for k, v in keys.items():
        df = df.filter(F.col(k) == v)
    rows = df.collect()
    assert len(rows) == 1, rows
    return rows[0]


def test_columns_are_added_in_place(pipeline_raw, judged):
    before, after = pipeline_raw.columns, judged.columns
    at = before.index("value") + 1
    assert after[:at] == before[:at] and [c for c in after if c in before] == before
    assert after[at:at + 7] == ["spec_position", "spec_usage", "normalized_value", "normalized_deviation",
                                "is_judgement_target", "is_ng", "ng_direction"]
    assert judged.count() == 13


@pytest.mark.parametrize("lot,frame,x,item,position,usage,deviation,direction", [
    ("0012", 3, 7, "Gap_v2", 1.5, None, 1.5, 1),        # above the upper limit
    ("L-7", 3, 2, "Gap_v2", -1.5, None, 1.5, -1),       # below the lower limit
    ("0012", 5, 2, "Gap_v2", -1.0, None, 1.0, 0),       # on the limit
    ("0012", 3, 2, "Scratch_v1", None, 1.125, 1.125, 1),
    ("L-7", 3, 2, "Scratch_v1", None, -0.125, 0.0, 0),  # better than best
    ("0012", 3, 2, "Flat_v3", None, None, None, 0),     # limits without room: judged, not normalised
    ("0012", 3, 7, "Flat_v3", None, None, None, 1),
])
def test_row_rules(judged, lot, frame, x, item, position, usage, deviation, direction):
    r = only(judged, lot_number=lot, FrameNo=frame, PositionX=x, colname=item)
    assert (r.spec_position, r.spec_usage, r.normalized_deviation) == (position, usage, deviation)
    assert r.normalized_value == (usage if position is None else position)
    assert r.is_judgement_target and r.is_ng == (direction != 0) and r.ng_direction == direction


def test_grains(judged):
    assert A.lots(judged).count() == 2
    assert A.frame_item_stats(judged).count() == 7
    assert A.position_item_stats(judged).count() == 12
    assert A.piece_ng(judged, BITS).count() == 6
    gap = only(A.frame_item_stats(judged), lot_number="0012", FrameNo=3, colname="Gap_v2")
    assert (gap.total_count, gap.sample_count, gap.ng_count, gap.minimum, gap.maximum) == (3, 3, 1, 3.0, 7.0)
    assert gap.ng_rate == pytest.approx(100 / 3) and gap.normalized_mean == pytest.approx(2 / 3)
    assert gap.normalized_std == pytest.approx((13 / 18) ** 0.5)
    assert [gap.p05, gap.p25, gap.p50, gap.p75, gap.p95] == pytest.approx([3.1, 3.5, 4.0, 5.5, 6.7])
    across = only(A.position_item_stats(judged), lot_number="0012", colname="Gap_v2", PositionX=2)
    assert (across.total_count, across.ng_count) == (2, 0) and across.normalized_mean == pytest.approx(0.75)


def test_two_categories_are_one_group(judged):
    """The grain is the item; a second category does not split it."""
    mix = only(A.frame_item_stats(judged), colname="Mix_v1")
    assert (mix.total_count, mix.meta_category) == (2, "a-mixed")
    assert [r.meta_category for r in A.position_item_stats(judged).filter("colname = 'Mix_v1'").orderBy("PositionX").collect()] \
        == ["b-mixed", "a-mixed"]
    row = V.fq_map(R.bundle_from_judged(judged, BITS, 4), ("Mix_v1",))
    assert row.groupBy("lot_number").count().agg(F.max("count")).first()[0] == 24


def test_histogram(judged):
    h = A.lot_item_histogram(judged, 4)
    assert h.agg(F.sum("count")).first()[0] == 13
    gap = {(r.lot_number, r.bin_index): r["count"] for r in h.filter("colname = 'Gap_v2'").collect()}
    # display range 1..7: bins of 1.5
    assert gap == {("0012", 0): 1, ("0012", 1): 1, ("0012", 2): 1, ("0012", 3): 1, ("L-7", 0): 1, ("L-7", 3): 1}
    outside = {(r.colname, r.lot_number): r["count"] for r in h.filter("bin_index IS NULL").collect()}
    assert outside == {("Scratch_v1", "L-7"): 1, ("Flat_v3", "0012"): 2}
    with pytest.raises(ValueError):
        A.lot_item_histogram(judged, 1)


def test_masks(judged):
    p = only(A.piece_ng(judged, BITS), lot_number="0012", FrameNo=3, PositionX=7)
    assert (p.total_item_count, p.ng_item_count, p.ng_mask, p.is_ng) == (4, 2, 0b110, True)
    fine = only(A.piece_ng(judged, BITS), lot_number="0012", FrameNo=3, PositionX=24)
    assert (fine.ng_item_count, fine.ng_mask, fine.is_ng) == (0, 0, False)


def test_repository(judged):
    b = R.bundle_from_judged(judged, BITS, 4)
    assert [r.lot_number for r in R.lots(b).collect()] == ["L-7", "0012"]
    assert R.ng_rate_by_frame(b).count() == R.ng_rate_by_frame(b, lots=()).count() == 7
    assert R.ng_rate_by_frame(b, lots=["L-7"]).count() == 2
    assert R.metrics_by_position(b, lots=["0012"]).count() == 9
    assert R.kde_bins(b, 4).count() > 0
    with pytest.raises(ValueError):
        R.kde_bins(b, 60)
    turned = R.piece_masks(b, ("Flat_v3", "Gap_v2")).filter("lot_number = '0012' AND FrameNo = 3 AND PositionX = 7")
    assert turned.first().ng_mask == 0b11
    with pytest.raises(KeyError):
        R.piece_masks(b, ("nope",))
    cells = R.frame_values(judged, "0012", 3, "Gap_v2").collect()
    assert [(r.PositionY, r.PositionX, r.ng_direction) for r in cells] == [(4, 2, 0), (9, 7, 1), (12, 24, 0)]


def test_read_orders(judged):
    """Reads come in the order of the grains; a histogram's out-of-range bin is its last."""
    b = R.bundle_from_judged(judged, BITS, 4)
    keys = [(r.lot_number, r.FrameNo, r.colname) for r in R.ng_rate_by_frame(b).collect()]
    assert keys == sorted(keys, key=lambda k: (k[0] == "0012", *k[1:]))
    bins = [r.bin_index for r in R.kde_bins(b, 4, ["0012"]).filter("colname IN ('Flat_v3', 'Gap_v2')").collect()]
    assert bins == [None, 0, 1, 2, 3]
    lot = [r.bin_index for r in R.kde_bins(b, 4, ["L-7"]).filter("colname = 'Scratch_v1'").collect()]
    assert lot == [None]
