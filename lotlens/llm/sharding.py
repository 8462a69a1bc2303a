"""Shards by jump consistent hashing: no ring table, only the necessary rows move.

A key walks through ever larger shard counts: from shard ``b`` it jumps to
``floor((b + 1) * 2^31 / (r + 1))`` with ``r`` the next 31 random bits of the
key; the last stop below the shard count is its shard.  The walk does not
depend on the count, so with one shard more a key either stays or goes to the
new shard, with probability 1 / (n + 1).  The random bits come from a
xorshift generator seeded with ``xxhash64(key)``, which needs nothing but
shifts and exclusive ors and so runs as plain Spark expressions.

Every row also gets a gapless slot within its shard.  Shards may hold any
number of rows, so no shard is numbered in one task: equal rows are counted
(map-side combined, so a key that repeats in a third of all rows is one row
per task), the counts are numbered within ``blocks`` hash blocks of each
shard, and the blocks' offsets come from a table of shards x blocks sums.

Defined results: a null text has size 16 and CRC 0; a null key is a key like
any other (all such rows share a shard); rows that repeat key and text get
slots of their own; an empty table gives an empty result; further input
columns, whatever their names, are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import whole_text

SHARDS = 40
#: Blocks that each shard is numbered in; offsets are a table of shards x blocks rows.
BLOCKS = 256
#: Bytes that each row has besides its text.
ROW_BYTES = 16


def _next_state(x: Column) -> Column:
    """xorshift64 with the full-period triple (13, 7, 17)."""
    x = x.bitwiseXOR(F.shiftleft(x, 13))
    x = x.bitwiseXOR(F.shiftrightunsigned(x, 7))
    return x.bitwiseXOR(F.shiftleft(x, 17))


def jump_shards(key: Column, shards: int) -> Column:
    """Struct (shard, grown): the shard of ``key`` among ``shards``, and among one more.

    One walk serves both counts.  It has at most ``shards + 1`` stops, and
    about ln(shards) on average; steps after its end change nothing.
    """
    seed = F.xxhash64(key)
    start = F.struct(
        F.when(seed == 0, F.lit(1).cast("long")).otherwise(seed).alias("x"),
        F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("shard"), F.lit(0).cast("long").alias("grown"))

    def step(s: Column, _: Column) -> Column:
        moved = F.struct(_next_state(s.x).alias("x"), s.at.alias("at"),
                         s.shard.alias("shard"), s.grown.alias("grown"))
        return F.when(s.at > shards, s).otherwise(F.transform(F.array(moved), jump)[0])

    def jump(s: Column) -> Column:
        draw = F.shiftrightunsigned(s.x, 33) + F.lit(1)
        to = F.floor((s.at + 1).cast("double") * F.lit(float(2 ** 31)) / draw.cast("double")).cast("long")
        return F.struct(s.x.alias("x"), to.alias("at"),
                        F.when(to < shards, to).otherwise(s.shard).alias("shard"),
                        F.when(to <= shards, to).otherwise(s.grown).alias("grown"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(shards)), start, step)


def shard_rows(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text",
               blocks: int = BLOCKS) -> DataFrame:
    """doc_id, size, text_crc32, law ('key'), shard, slot, grown_shard; a row per input row."""
    text = whole_text(text_col)
    sized = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + F.lit(ROW_BYTES)).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"))
    distinct = sized.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("copies"))
    placed = (distinct
              .withColumn("walk", jump_shards(F.col("doc_id"), shards))
              .select("doc_id", "size", "text_crc32", "copies",
                      # never null; said so that no null filter repeats the walk below the counts
                      F.coalesce(F.col("walk.shard").cast("int"), F.lit(0)).alias("shard"),
                      F.col("walk.grown").cast("int").alias("grown_shard"),
                      F.pmod(F.xxhash64("text_crc32", "doc_id", "size"), F.lit(blocks)).cast("int").alias("block")))
    totals = placed.groupBy("shard", "block").agg(F.sum("copies").alias("rows"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("shard", "block", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))
    within = (Window.partitionBy("shard", "block").orderBy("doc_id", "size", "text_crc32")
              .rowsBetween(Window.unboundedPreceding, -1))
    numbered = (placed.withColumn("earlier", F.coalesce(F.sum("copies").over(within), F.lit(0)))
                # shards x blocks rows at most
                .join(F.broadcast(offsets), ["shard", "block"]))
    copy = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy")
    return numbered.select("*", copy).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("offset") + F.col("earlier") + F.col("copy")).alias("slot"), "grown_shard")
