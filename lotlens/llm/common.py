"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotlens.session import scratch_path

#: Words are runs of anything but the six ASCII blanks (space, tab, newline, VT, FF, CR).
BLANKS = r"[\x20\x09-\x0D]+"


def materialised(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts the lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def whole_text(text: Column | str) -> Column:
    """The text, a null one as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` runs (null: 0), JVM-side.

    A word starts wherever a non-blank follows a blank or the beginning.
    """
    blanks = F.lit(" \t\n\x0b\x0c\r")
    trimmed = F.btrim(whole_text(text), blanks)
    return F.when(trimmed == "", F.lit(0)).otherwise(
        F.size(F.split(trimmed, BLANKS))).cast("long")


def spare_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores until no column of ``df`` is called so (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions_for(spark: SparkSession, at_least: int = 1) -> int:
    """The session's shuffle partitions, as explicit count for keyed repartitions."""
    return max(at_least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def bitmap(hashes: DataFrame, cell_words: int) -> DataFrame:
    """One row: ``cell_words`` longs with the bits of all values of ``hashes.hash`` (a bigint column).

    Its size does not depend on the number of values; with more of them it only lets more pass.
    """
    cells = (hashes.select(F.pmod(F.shiftrightunsigned("hash", 6), F.lit(cell_words)).alias("cell"),
                           F.expr("shiftleft(1L, cast(hash & 63L as int))").alias("bit"))
             .groupBy("cell").agg(F.bit_or("bit").alias("bits")))
    every = hashes.sparkSession.range(cell_words).withColumnRenamed("id", "cell")
    dense = every.join(cells, "cell", "left").agg(
        F.array_sort(F.collect_list(F.struct("cell", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))))
        .alias("cells"))
    return dense.select(F.expr("transform(cells, c -> c.bits)").alias("cells"))


def in_bitmap(cells: str, value: str, cell_words: int) -> str:
    """SQL: whether the bitmap column ``cells`` has the bit of ``value``."""
    return (f"getbit({cells}[cast(pmod(shiftrightunsigned({value}, 6), {cell_words}L) as int)], "
            f"cast({value} & 63L as int)) = 1")
