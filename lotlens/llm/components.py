"""Connected components (of a block in a task, of written tables), and a join that spreads keys which many rows share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialised

#: A key is dealt to several tasks from this share of all rows on (and from this many rows on).
SHARE, LEAST = 1000, 10_000


def spread_join(rows: DataFrame, key: str, table: DataFrame, on: str) -> DataFrame:
    """Inner join of ``rows`` (a written table) with ``table``, unique in ``on``.

    Keys of more than a ``SHARE``-th of the rows go to several tasks, each with a copy of their one row of ``table``.
    There are fewer than ``SHARE`` such keys, whatever the input, so their list is broadcast.
    """
    total = rows.count()
    least = max(total // SHARE, LEAST)
    heavy = (rows.groupBy(F.col(key).alias("heavy_key")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > least)
             .select("heavy_key", F.ceil(F.col("n") / F.lit(least)).cast("int").alias("pieces")))
    if total <= LEAST or heavy.isEmpty():
        return rows.join(table, rows[key] == table[on])
    heavy = F.broadcast(materialised(heavy, "heavy-keys"))
    dealt = (rows.join(heavy, rows[key] == F.col("heavy_key"), "left")
             .withColumn("piece", F.when(F.col("pieces").isNull(), 0).otherwise(
                 F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("pieces")).cast("int")))
             .drop("heavy_key", "pieces"))
    copied = (table.join(heavy, table[on] == F.col("heavy_key"), "left")
              .withColumn("table_piece", F.explode(F.sequence(F.lit(0), F.coalesce("pieces", F.lit(1)) - 1)))
              .drop("heavy_key", "pieces"))
    return dealt.join(copied, (F.col(key) == F.col(on)) & (F.col("piece") == F.col("table_piece"))).drop("piece", "table_piece")


def connected(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels (a smaller or equal index of the same group each) after joining the groups of each i and j."""
    while True:
        low, high = np.minimum(label[i], label[j]), np.maximum(label[i], label[j])
        apart = low != high
        if not apart.any():
            return label
        np.minimum.at(label, high[apart], low[apart])
        while (label[label] != label).any():
            label = label[label]


def components(pairs: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of ``pairs`` (a, b) reaches.

    Labels fall to the smallest of the neighbours' and then to their label's own label, until
    nothing changes; each round is written out.  Nodes of many neighbours and labels of many nodes are spread.
    """
    edges = materialised(pairs.select("a", "b").union(pairs.select("b", "a")).filter("a <> b").distinct(), "edges")
    labels = materialised(edges.groupBy("a").agg(F.min("b").alias("low"))
                          .select(F.col("a").alias("node"), F.least("a", "low").alias("label")), "labels")
    while True:
        beside = (spread_join(edges, "b", labels, "node").groupBy("a").agg(F.min("label").alias("low")))
        lower = materialised(labels.join(beside, labels["node"] == beside["a"])
                             .select("node", F.col("label").alias("was"), F.least("label", "low").alias("label")), "lower")
        above = lower.select(F.col("node").alias("up"), F.col("label").alias("up_label"))
        written = materialised(spread_join(lower, "label", above, "up")
                               .select("node", "was", F.least("label", "up_label").alias("label")), "labels")
        labels = written.select("node", "label")
        if written.filter("label <> was").isEmpty():
            return labels.select("node", F.col("label").alias("root"))
