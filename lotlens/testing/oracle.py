"""DuckDB restatement of the fixture adapters and stages (test oracle only).

Each ``oracle_sql`` entry is ``WITH <base CTEs>, q AS (<body>) SELECT <cols>
FROM q``; double columns are cut to significant digits with a tie guard on
both sides (see ``lotlens.testing.stable``) because float sums differ in the
last bits between engines.
"""

from __future__ import annotations

from lotlens.contracts import ItemSpec
from lotlens.sources.fixtures import _LINEITEM_MEASURES, EVENT_ITEMS, LINEITEM_ITEMS

#: Significant digits that are compared, what a tie is pushed by, and what counts as nothing.
DIGITS = 7
TIE_GUARD = 1e-10
NOISE = 1e-9


def _lit(v) -> str:
    if v is None:
        return "CAST(NULL AS DOUBLE)"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, (int, float)):
        return f"CAST({float(v)!r} AS DOUBLE)"
    return "'" + str(v).replace("'", "''") + "'"


def items_cte(items: tuple[ItemSpec, ...], name: str = "items") -> str:
    rows = ",\n    ".join(
        f"({_lit(i.colname)}, {idx}, {_lit(i.limmin)}, {_lit(i.limmax)}, {_lit(i.meta_best)}, "
        f"{_lit(i.meta_type)}, {_lit(i.meta_ignore)}, {_lit(i.meta_category)}, {_lit(i.meta_unit)})"
        for idx, i in enumerate(items))
    return (f"{name}(colname, spec_order, limmin, limmax, meta_best, meta_type, meta_ignore, "
            f"meta_category, meta_unit) AS (VALUES\n    {rows})")


def fin(x: str) -> str:
    return f"coalesce(isfinite({x}), FALSE)"


STAGES = f"""
std AS (
  SELECT *,
    CASE WHEN {fin('limmin')} AND {fin('limmax')} AND limmax <> limmin AND NOT isnan(value)
         THEN (value - (limmin + limmax) / 2.0::DOUBLE) / ((limmax - limmin) / 2.0::DOUBLE) END
      AS spec_position,
    CASE WHEN NOT {fin('limmin')} AND {fin('meta_best')} AND {fin('limmax')}
              AND limmax <> meta_best AND NOT isnan(value)
         THEN (value - meta_best) / (limmax - meta_best) END AS spec_usage
  FROM raw
),
flags AS (
  SELECT *, coalesce(meta_type = 'spec' AND NOT meta_ignore, FALSE) AS is_judgement_target
  FROM std
),
ng AS (
  SELECT *,
    coalesce(is_judgement_target AND value IS NOT NULL AND NOT isnan(value)
             AND {fin('limmin')} AND value < limmin, FALSE) AS lower_ng,
    coalesce(is_judgement_target AND value IS NOT NULL AND NOT isnan(value)
             AND {fin('limmax')} AND value > limmax, FALSE) AS upper_ng
  FROM flags
),
judged AS (
  SELECT vision, lot_number, lot_start_time, FrameNo, PositionX, PositionY, value,
    spec_position, spec_usage,
    CASE WHEN {fin('spec_position')} THEN spec_position ELSE spec_usage END AS normalized_value,
    CASE WHEN {fin('spec_position')} THEN abs(spec_position)
         WHEN spec_usage IS NOT NULL THEN greatest(spec_usage, 0.0::DOUBLE) END
      AS normalized_deviation,
    is_judgement_target,
    lower_ng OR upper_ng AS is_ng,
    CAST(CASE WHEN lower_ng THEN -1 WHEN upper_ng THEN 1 ELSE 0 END AS TINYINT) AS ng_direction,
    colname, limmin, limmax, meta_type, meta_ignore, meta_best, meta_category, meta_unit,
    measure_id
  FROM ng
),
targets AS (SELECT * FROM judged WHERE is_judgement_target)"""

EVENTS_RAW = f"""
{items_cte(EVENT_ITEMS)},
ev AS (
  SELECT
    'vision_' || CAST(event_id % 3 + 1 AS VARCHAR) AS vision,
    'LOT_' || CAST(CAST(ts AS DATE) AS VARCHAR) AS lot_number,
    CAST(CAST(ts AS DATE) AS TIMESTAMP) AS lot_start_time,
    CAST(hour(ts) + 1 AS SMALLINT) AS FrameNo,
    CAST(user_id % 24 + 1 AS TINYINT) AS PositionX,
    CAST(CAST(floor(user_id / 24) AS INTEGER) % 12 + 1 AS TINYINT) AS PositionY,
    value,
    event_type || '_v' || CAST(event_id % 3 + 1 AS VARCHAR) AS colname,
    event_id AS measure_id
  FROM events
),
raw AS (
  SELECT ev.*, i.limmin, i.limmax, i.meta_type, i.meta_ignore, i.meta_best,
         i.meta_category, i.meta_unit
  FROM ev JOIN items i ON ev.colname = i.colname
)"""


def _lineitem_raw() -> str:
    unions = "\n  UNION ALL\n".join(
        f"  SELECT lot_number, lot_start_time, FrameNo, PositionX, PositionY, vision_k, "
        f"'{base}' AS base, CAST({col} AS DOUBLE) AS value FROM li"
        for (base, col, *_r) in _LINEITEM_MEASURES)
    return f"""
{items_cte(LINEITEM_ITEMS)},
li AS (
  SELECT
    'LOT_' || strftime(date_trunc('month', CAST(l_shipdate AS DATE)), '%Y-%m') AS lot_number,
    CAST(date_trunc('month', CAST(l_shipdate AS DATE)) AS TIMESTAMP) AS lot_start_time,
    CAST(least(day(l_shipdate), 24) AS SMALLINT) AS FrameNo,
    CAST(l_suppkey % 24 + 1 AS TINYINT) AS PositionX,
    CAST(l_partkey % 12 + 1 AS TINYINT) AS PositionY,
    l_linenumber % 3 + 1 AS vision_k,
    {", ".join(c for (_b, c, *_r) in _LINEITEM_MEASURES)}
  FROM lineitem
),
melted AS (
{unions}
),
raw AS (
  SELECT 'vision_' || CAST(m.vision_k AS VARCHAR) AS vision, m.lot_number, m.lot_start_time,
    m.FrameNo, m.PositionX, m.PositionY,
    CASE WHEN m.value = 0 THEN 0.0::DOUBLE ELSE m.value END AS value,
    m.base || '_v' || CAST(m.vision_k AS VARCHAR) AS colname,
    i.limmin, i.limmax, i.meta_type, i.meta_ignore, i.meta_best, i.meta_category, i.meta_unit,
    CAST(NULL AS BIGINT) AS measure_id
  FROM melted m JOIN items i ON m.base || '_v' || CAST(m.vision_k AS VARCHAR) = i.colname
)"""


LINEITEM_RAW = _lineitem_raw()


def rounded(name: str) -> str:
    x = f'CAST("{name}" AS DOUBLE)'
    text = f"printf('%.{DIGITS - 1}e', {x} * {1 + TIE_GUARD!r}::DOUBLE)"
    return (f'CASE WHEN {x} IS NULL OR isnan({x}) THEN {x} WHEN abs({x}) < {NOISE!r}::DOUBLE THEN 0.0::DOUBLE '
            f'ELSE CAST({text} AS DOUBLE) END AS "{name}"')


def wrap(body: str, doubles: tuple[str, ...] | list[str], *, source: str = "events",
         extra_ctes: str = "") -> str:
    """Full oracle statement: base CTEs + optional extra CTEs + body, doubles rounded."""
    base = EVENTS_RAW if source == "events" else LINEITEM_RAW
    extra = f",\n{extra_ctes.strip().rstrip(',')}" if extra_ctes.strip() else ""
    proj = ", ".join(["* EXCLUDE (" + ", ".join(f'"{d}"' for d in doubles) + ")"] if doubles else ["*"])
    if doubles:
        proj = proj + ", " + ", ".join(rounded(d) for d in doubles)
    return f"WITH {base.strip()},\n{STAGES.strip()}{extra},\nq AS (\n{body.strip()}\n)\nSELECT {proj} FROM q"
