"""Processing-path catalog and path series."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lotlens.contracts import RAW_SCHEMA
from lotlens.operators import frames as FR
from lotlens.operators.rows import judge, standardize
from lotlens.sources.paths import builtin_catalog, load_catalog, path_catalog, path_violations
from tests.conftest import raw_row


def test_builtin_catalog_shapes(spark):
    cat = path_catalog(spark)
    counts = {(r.equipment_id, r.path_id): r["count"] for r in cat.groupBy("equipment_id", "path_id").count().collect()}
    assert counts[("row_serpentine", "main")] == 288
    assert [counts[("mold_4flow", f"flow_{k}")] for k in (1, 2, 3, 4)] == [72] * 4
    main = [(r.PositionX, r.PositionY) for r in cat.filter("path_id = 'main'").orderBy("step").collect()]
    for i, (x, y) in enumerate(main):
        assert y == i // 24 + 1
        assert x == (i % 24 + 1 if y % 2 == 1 else 24 - i % 24)
    flow2 = [(r.PositionX, r.PositionY) for r in cat.filter("path_id = 'flow_2'").orderBy("step").collect()]
    assert flow2[0] == (1, 4) and flow2[24] == (24, 5) and flow2[-1] == (24, 6)
    assert path_violations(spark, builtin_catalog()).count() == 0


@pytest.mark.parametrize("mutate, rule", [
    (lambda c: c["equipments"].append(dict(c["equipments"][0])), "duplicate_equipment_id"),
    (lambda c: c.update(default_equipment_id="nope"), "unknown_default_equipment"),
    (lambda c: c["equipments"][1]["paths"].append(dict(c["equipments"][1]["paths"][0])), "duplicate_path_id"),
    (lambda c: c["equipments"][0]["paths"][0].update(positions=[]), "empty_path"),
    (lambda c: c["equipments"][0]["paths"][0]["positions"].append([1, 1]), "duplicate_position"),
    (lambda c: c["equipments"][0]["paths"][0]["positions"].append([25, 1]), "position_out_of_range"),
    (lambda c: c["equipments"][0]["paths"][0]["positions"].append([3, 13]), "position_out_of_range"),
    (lambda c: c["equipments"][0]["paths"][0]["positions"].append([0, 2]), "position_out_of_range"),
    (lambda c: c["equipments"][0].update(paths=[]), "no_paths"),
    (lambda c: c.update(equipments=[]), "no_equipment"),
])
def test_planted_violations(spark, mutate, rule):
    cat = builtin_catalog()
    mutate(cat)
    rules = {r.rule for r in path_violations(spark, cat).collect()}
    assert rule in rules


def test_toml_roundtrip(tmp_path):
    p = tmp_path / "paths.toml"
    p.write_text('schema_version = 1\ndefault_equipment_id = "m"\n[[equipments]]\nid = "m"\nlabel = "M"\n'
                 '[[equipments.paths]]\nid = "p"\nlabel = "P"\npositions = [[1, 1], [2, 1]]\n')
    cat = load_catalog(str(p))
    assert cat["equipments"][0]["paths"][0]["positions"] == [[1, 1], [2, 1]]
    p.write_text('schema_version = 2\n')
    with pytest.raises(ValueError):
        load_catalog(str(p))


def test_path_series_on_index_grid(spark):
    t0 = datetime(2026, 1, 1)
    rows = [raw_row("L", t0, 1, x, y, float(24 * (y - 1) + (x - 1)), "g_v1", 0.0, 1000.0, None)
            for y in range(1, 13) for x in range(1, 25)]
    rows[0] = raw_row("L", t0, 1, 1, 1, -1.0, "g_v1", 0.0, 1000.0, None)          # lower NG at (1,1)
    rows[24 + 1] = raw_row("L", t0, 1, 2, 2, 2000.0, "g_v1", 0.0, 1000.0, None)   # upper NG at (2,2)
    j = spark.createDataFrame(rows, RAW_SCHEMA).transform(standardize).transform(judge)
    grid = FR.frame_grid(j)
    cat = {"schema_version": 1, "default_equipment_id": "m",
           "equipments": [{"id": "m", "label": "M", "paths": [
               {"id": "p", "label": "P", "positions": [[1, 1], [2, 1], [2, 2]]}]}]}
    s = FR.path_series(grid, path_catalog(spark, cat), "m").orderBy("step").collect()
    assert [r.step for r in s] == [1, 2, 3]
    assert [r.value for r in s] == [-1.0, 1.0, 2000.0]
    assert [r.ng_direction for r in s] == [-1, 0, 1]
    rng = FR.path_plot_range(FR.path_series(grid, path_catalog(spark, cat), "m")).first()
    assert rng.x_min == pytest.approx(1 - 2 * 0.03) and rng.x_max == pytest.approx(3 + 2 * 0.03)
    assert grid.count() == 288 and grid.filter(F.col("value").isNull()).count() == 0
