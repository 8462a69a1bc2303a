"""Registered queries over the driver's tables and their DuckDB oracles.

Every entry reads the given tables (``events`` / ``lineitem``) in full and
runs a library operator on them; the oracle restates the same semantics in
SQL.  Double columns are rounded identically on both sides (``stable``).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from lotlens.session import scratch_path
from lotlens.testing import stable
from lotlens.testing.oracle import wrap


@dataclass
class Entry:
    fn: Callable[[SparkSession, str], DataFrame]
    raw: Callable[[SparkSession, str], DataFrame]
    body: str | None
    doubles: tuple[str, ...]
    source: str
    extra_ctes: str

    def sql(self) -> str | None:
        if self.body is None:
            return None
        return wrap(self.body, self.doubles, source=self.source, extra_ctes=self.extra_ctes)


REGISTRY: dict[str, Entry] = {}


def register(key: str, body: str | None, doubles: tuple[str, ...] | list[str] = (), *,
             source: str = "events", extra_ctes: str = ""):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return stable(fn(spark, sf_dir))
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        REGISTRY[key] = Entry(run, fn, body, tuple(doubles), source, extra_ctes)
        return fn
    return deco


def scratch_dir(spark: SparkSession, name: str) -> str:
    return scratch_path(spark, name)


def _load():
    # importing the modules fills REGISTRY
    from lotlens.testing import queries_core, queries_views  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {k: e.fn for k, e in REGISTRY.items()}


def operators() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The registered queries without the comparison rounding (for timing)."""
    _load()
    return {k: e.raw for k, e in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    out = {}
    for k, e in REGISTRY.items():
        s = e.sql()
        if s is not None:
            out[k] = s
    return out
