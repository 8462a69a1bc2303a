"""Processing-path catalog: per machine, ordered cell paths over the 24 x 12 frame.

The catalog is configuration (TOML: ``schema_version``,
``default_equipment_id``, ``[[equipments]]`` with ``[[equipments.paths]]``
holding ``positions = [[x, y], ...]``).  ``builtin_catalog`` generates the
two standard machines from their rule; ``load_catalog`` reads a TOML file.
Its table form is an inline relation, so Spark knows its size and chooses the
form of its joins.
"""

from __future__ import annotations

import tomllib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotlens.contracts import POSITION_X, POSITION_Y, literal_table

SCHEMA_VERSION = 1

PATH_SCHEMA = T.StructType([
    T.StructField("equipment_index", T.IntegerType(), False),
    T.StructField("equipment_id", T.StringType(), False),
    T.StructField("equipment_label", T.StringType(), False),
    T.StructField("path_index", T.IntegerType(), False),
    T.StructField("path_id", T.StringType(), False),
    T.StructField("label", T.StringType(), False),
    T.StructField("step", T.IntegerType(), False),
    T.StructField("PositionX", T.IntegerType(), False),
    T.StructField("PositionY", T.IntegerType(), False),
])


def serpentine(rows: list[int], width: int = len(POSITION_X)) -> list[list[int]]:
    """Row-by-row boustrophedon: the first listed row left to right, the next
    right to left, and so on.  Returns [[x, y], ...]."""
    cells = []
    for k, y in enumerate(rows):
        xs = range(1, width + 1) if k % 2 == 0 else range(width, 0, -1)
        cells.extend([x, y] for x in xs)
    return cells


def builtin_catalog() -> dict:
    """The standard machines: one full-frame serpentine, and a 4-flow mould
    whose flows each serpentine over three consecutive rows."""
    ys = list(POSITION_Y)
    return {
        "schema_version": SCHEMA_VERSION,
        "default_equipment_id": "row_serpentine",
        "equipments": [
            {"id": "row_serpentine", "label": "machine A (row serpentine)",
             "paths": [{"id": "main", "label": "processing path", "positions": serpentine(ys)}]},
            {"id": "mold_4flow", "label": "mould (4 parallel flows)",
             "paths": [{"id": f"flow_{k + 1}", "label": f"resin flow {k + 1}",
                        "positions": serpentine(ys[3 * k:3 * k + 3])} for k in range(4)]},
        ],
    }


def load_catalog(path: str) -> dict:
    """Parse a TOML catalog; only schema version 1 is accepted."""
    with open(path, "rb") as fh:
        source = tomllib.load(fh)
    if source.get("schema_version") != SCHEMA_VERSION:
        raise ValueError("unsupported path catalog schema version")
    return source


def catalog_rows(catalog: dict) -> list[tuple]:
    rows = []
    for ei, eq in enumerate(catalog.get("equipments", [])):
        for pi, path in enumerate(eq.get("paths", [])):
            for step, pos in enumerate(path.get("positions", []), start=1):
                rows.append((ei, str(eq["id"]), str(eq.get("label", "")), pi, str(path["id"]),
                             str(path.get("label", "")), step, int(pos[0]), int(pos[1])))
    return rows


def path_catalog(spark: SparkSession, catalog: dict | None = None) -> DataFrame:
    """Catalog as a table (equipment, path, step, PositionX, PositionY)."""
    return literal_table(spark, catalog_rows(catalog or builtin_catalog()), PATH_SCHEMA)


def path_violations(spark: SparkSession, catalog: dict) -> DataFrame:
    """Catalog rules as a violations table (rule, equipment_id, path_id, step):
    at least one machine, unique machine ids, default machine defined, at
    least one path per machine, unique path ids per machine, non-empty paths,
    no repeated cell in a path, 1 <= x <= 24 and 1 <= y <= 12."""
    eqs = spark.createDataFrame(
        [(i, str(e["id"]), len(e.get("paths", []))) for i, e in enumerate(catalog.get("equipments", []))],
        "equipment_index int, equipment_id string, n_paths int")
    paths = spark.createDataFrame(
        [(i, str(e["id"]), j, str(p["id"]), len(p.get("positions", [])))
         for i, e in enumerate(catalog.get("equipments", [])) for j, p in enumerate(e.get("paths", []))],
        "equipment_index int, equipment_id string, path_index int, path_id string, n_positions int")
    cells = path_catalog(spark, catalog)
    none = F.lit(None).cast("string")
    nstep = F.lit(None).cast("int")
    default = str(catalog.get("default_equipment_id", ""))
    out = [
        eqs.agg(F.count(F.lit(1)).alias("n")).filter("n = 0").select(
            F.lit("no_equipment").alias("rule"), none.alias("equipment_id"), none.alias("path_id"),
            nstep.alias("step")),
        eqs.groupBy("equipment_id").count().filter("count > 1").select(
            F.lit("duplicate_equipment_id").alias("rule"), "equipment_id", none.alias("path_id"),
            nstep.alias("step")),
        eqs.filter(F.col("equipment_id") == default).agg(F.count(F.lit(1)).alias("n")).filter("n = 0")
        .select(F.lit("unknown_default_equipment").alias("rule"), F.lit(default).alias("equipment_id"),
                none.alias("path_id"), nstep.alias("step")),
        eqs.filter("n_paths = 0").select(F.lit("no_paths").alias("rule"), "equipment_id",
                                         none.alias("path_id"), nstep.alias("step")),
        paths.groupBy("equipment_index", "equipment_id", "path_id").count().filter("count > 1").select(
            F.lit("duplicate_path_id").alias("rule"), "equipment_id", "path_id", nstep.alias("step")),
        paths.filter("n_positions = 0").select(F.lit("empty_path").alias("rule"), "equipment_id", "path_id",
                                               nstep.alias("step")),
        cells.groupBy("equipment_index", "equipment_id", "path_index", "path_id", "PositionX", "PositionY")
        .agg(F.max("step").alias("step"), F.count(F.lit(1)).alias("n")).filter("n > 1").select(
            F.lit("duplicate_position").alias("rule"), "equipment_id", "path_id", "step"),
        cells.filter((F.col("PositionX") < POSITION_X[0]) | (F.col("PositionX") > POSITION_X[-1])
                     | (F.col("PositionY") < POSITION_Y[0]) | (F.col("PositionY") > POSITION_Y[-1]))
        .select(F.lit("position_out_of_range").alias("rule"), "equipment_id", "path_id", "step"),
    ]
    result = out[0]
    for df in out[1:]:
        result = result.unionByName(df)
    return result
