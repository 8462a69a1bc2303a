"""Column-expression helpers (all JVM-side, codegen friendly, no UDFs)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from lotlens.contracts import check_item_names

INF = float("inf")


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: str | Column) -> Column:
    """True when the value is present, not NaN and not infinite (never null)."""
    x = col(c)
    return F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(INF)), F.lit(False))


def nice_upper(c: str | Column, minimum: float) -> Column:
    """Round a positive level up to 1/2/3/5/10 x 10^k, never below ``minimum``.

    ``<= 0`` gives ``minimum``; null/NaN gives null.
    """
    x = col(c)
    magnitude = F.pow(F.lit(10.0), F.floor(F.log10(x)).cast("double"))
    normalized = x / magnitude
    stepped = (
        F.when(normalized <= 1.0, F.lit(1.0) * magnitude)
        .when(normalized <= 2.0, F.lit(2.0) * magnitude)
        .when(normalized <= 3.0, F.lit(3.0) * magnitude)
        .when(normalized <= 5.0, F.lit(5.0) * magnitude)
        .when(normalized <= 10.0, F.lit(10.0) * magnitude)
        .otherwise(x)
    )
    return (
        F.when(x.isNull() | F.isnan(x), F.lit(None).cast("double"))
        .when(x <= 0.0, F.lit(float(minimum)))
        .otherwise(F.greatest(F.lit(float(minimum)), stepped))
    )


def padded_range(lo: Column, hi: Column) -> tuple[Column, Column]:
    """Raw range widened by 4% of ``max(span, |hi|*1%, 1e-9)`` on each side."""
    span = F.greatest(hi - lo, F.abs(hi) * F.lit(0.01), F.lit(1e-9))
    return lo - span * F.lit(0.04), hi + span * F.lit(0.04)


def spec_display_range(lower: Column, upper: Column, best: Column,
                       raw_lo: Column, raw_hi: Column) -> tuple[Column, Column]:
    """Display range of an item from its spec shape, else from the raw range.

    two-sided: limits +- a quarter of the spec span; upper+best: best ..
    best + 1.2 (upper - best); lower+best: lower - (best - lower)/5 .. best;
    otherwise the padded raw range.  ``lower/upper/best`` are null when absent.
    """
    fb_lo, fb_hi = padded_range(raw_lo, raw_hi)
    two = lower.isNotNull() & upper.isNotNull()
    up_best = upper.isNotNull() & best.isNotNull()
    lo_best = lower.isNotNull() & best.isNotNull()
    lo = (F.when(two, lower - (upper - lower) / F.lit(4.0))
          .when(up_best, best)
          .when(lo_best, lower - (best - lower) / F.lit(5.0))
          .otherwise(fb_lo))
    hi = (F.when(two, upper + (upper - lower) / F.lit(4.0))
          .when(up_best, best + (upper - best) * F.lit(1.2))
          .when(lo_best, best)
          .otherwise(fb_hi))
    return lo, hi


def floor_bin(value: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Lot-histogram bin: null outside [lo, hi] (or no value), else
    ``least(bins-1, floor((v-lo)/(hi-lo)*bins))``; a zero-width range gives null."""
    width = hi - lo
    raw = F.floor((value - lo) / F.when(width != 0, width) * F.lit(float(bins)))
    return (
        F.when(value.isNull() | F.isnan(value) | (value < lo) | (value > hi) | (width == 0),
               F.lit(None).cast("int"))
        .otherwise(F.least(F.lit(bins - 1), raw.cast("int")))
    )


def linspace_edge(lo: Column, hi: Column, index: Column, bins: int) -> Column:
    """Edge ``index`` of ``bins+1`` evenly spaced edges from lo to hi (last = hi)."""
    step = (hi - lo) / F.lit(float(bins))
    return F.when(index == bins, hi).otherwise(index.cast("double") * step + lo)


def edge_bin(value: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Bin of ``value`` against explicit linspace edges: [e_i, e_i+1) with the
    last bin closed.  Caller keeps only ``lo <= value <= hi``.  The floor guess
    is corrected by one against the actual edges, so values on an edge land
    where an edge-search would put them."""
    step = (hi - lo) / F.lit(float(bins))
    guess = F.least(F.lit(bins - 1),
                    F.greatest(F.lit(0), F.floor((value - lo) / F.when(step != 0, step)).cast("int")))
    guess = F.coalesce(guess, F.lit(0))
    down = F.when((guess > 0) & (value < linspace_edge(lo, hi, guess, bins)), guess - 1).otherwise(guess)
    return F.when((down < bins - 1) & (value >= linspace_edge(lo, hi, down + 1, bins)),
                  down + 1).otherwise(down)


def gaussian_kernel(sigma: float) -> list[float]:
    """Normalised Gaussian taps in bin units, radius ceil(4 sigma)."""
    radius = math.ceil(4.0 * sigma)
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    total = sum(raw)
    return [w / total for w in raw]


def bit_lookup(colname: Column, names: tuple[str, ...] | list[str]) -> Column:
    """Bit value ``1 << index`` of ``colname`` in ``names`` (63 at most); 0 when unknown."""
    check_item_names(names)
    if not names:
        return F.lit(0).cast("long")
    mapping = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(1 << i))])
    return F.coalesce(F.try_element_at(mapping, colname).cast("long"), F.lit(0).cast("long"))
