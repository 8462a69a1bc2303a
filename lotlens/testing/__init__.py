"""Test-only helpers: value normalisation for engine-to-engine comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotlens.testing.oracle import DIGITS, NOISE, TIE_GUARD


def stable(df: DataFrame) -> DataFrame:
    """Every double column to ``DIGITS`` significant digits, with a tie guard, and -0.0 as 0.0."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            x = F.col(f.name).cast("double")
            text = F.format_string(f"%.{DIGITS - 1}e", x * F.lit(1 + TIE_GUARD))
            # what is left of a difference of equal numbers is noise
            cols.append(F.when(x.isNull() | F.isnan(x), x).when(F.abs(x) < NOISE, F.lit(0.0))
                        .otherwise(text.cast("double")).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)
