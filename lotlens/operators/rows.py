"""Row-level stages: raw -> standardized -> judged (no grain change, no shuffle).

Both stages are one projection each, so ``raw.transform(standardize)
.transform(judge)`` fuses into the scan's whole-stage-codegen span.  The
formulas are Spark SQL expressions (parsed once in the JVM), which keeps the
driver-side plan construction cheap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotlens.contracts import JUDGED_ADDED, STANDARDIZED_ADDED, TARGET_META_TYPE, insert_after


def fin(c: str) -> str:
    """SQL: present, not NaN, not infinite (never null)."""
    return f"coalesce({c} IS NOT NULL AND NOT isnan({c}) AND abs({c}) != CAST('Infinity' AS DOUBLE), false)"


# Two-sided spec: (v - centre) / half-width; null otherwise (and for a
# zero-width spec or a NaN value).
SPEC_POSITION = (f"CASE WHEN {fin('limmin')} AND {fin('limmax')} AND limmax != limmin AND NOT isnan(value) "
                 f"THEN (value - (limmin + limmax) / 2.0D) / ((limmax - limmin) / 2.0D) END")
# Upper spec with a best value and no finite lower limit: (v - best)/(upper - best).
SPEC_USAGE = (f"CASE WHEN NOT {fin('limmin')} AND {fin('meta_best')} AND {fin('limmax')} "
              f"AND limmax != meta_best AND NOT isnan(value) "
              f"THEN (value - meta_best) / (limmax - meta_best) END")

TARGET = f"coalesce(meta_type = '{TARGET_META_TYPE}' AND NOT meta_ignore, false)"
_VALID = "(value IS NOT NULL AND NOT isnan(value))"
LOWER_NG = f"coalesce({TARGET} AND {_VALID} AND {fin('limmin')} AND value < limmin, false)"
UPPER_NG = f"coalesce({TARGET} AND {_VALID} AND {fin('limmax')} AND value > limmax, false)"

JUDGED_EXPR = {
    "normalized_value": f"CASE WHEN {fin('spec_position')} THEN spec_position ELSE spec_usage END",
    "normalized_deviation": (f"CASE WHEN {fin('spec_position')} THEN abs(spec_position) "
                             f"WHEN spec_usage IS NOT NULL THEN greatest(spec_usage, 0.0D) END"),
    "is_judgement_target": TARGET,
    "is_ng": f"({LOWER_NG}) OR ({UPPER_NG})",
    "ng_direction": f"CAST(CASE WHEN {LOWER_NG} THEN -1 WHEN {UPPER_NG} THEN 1 ELSE 0 END AS TINYINT)",
}


def spec_position() -> Column:
    return F.expr(SPEC_POSITION)


def spec_usage() -> Column:
    return F.expr(SPEC_USAGE)


def _project(df: DataFrame, anchor: str, added: tuple[str, ...], exprs: dict[str, str]) -> DataFrame:
    cols = [F.expr(exprs[c]).alias(c) if c in exprs else F.col(c)
            for c in insert_after(df.columns, anchor, added)]
    return df.select(*cols)


def standardize(raw: DataFrame) -> DataFrame:
    """Add ``spec_position`` and ``spec_usage`` right after ``value``."""
    return _project(raw, "value", STANDARDIZED_ADDED,
                    {"spec_position": SPEC_POSITION, "spec_usage": SPEC_USAGE})


def judge(standardized: DataFrame) -> DataFrame:
    """Add normalised value/deviation, target flag, NG flag and direction.

    * normalized_value = spec_position if finite else spec_usage
    * normalized_deviation = |spec_position|, else max(spec_usage, 0), else null
    * target = meta_type = 'spec' and not meta_ignore
    * lower NG: target and finite(limmin) and value < limmin (strict); upper
      alike; direction -1 / +1 / 0, lower wins.  NaN values are never NG.
    """
    return _project(standardized, "spec_usage", JUDGED_ADDED, JUDGED_EXPR)


def judged_targets(judged: DataFrame) -> DataFrame:
    """Target rows only (the input of every grain except ``lots``)."""
    return judged.filter(F.col("is_judgement_target"))
