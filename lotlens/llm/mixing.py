"""Mixing sources to target weights: floor(rate) copies of each document plus one Bernoulli copy.

Tokens (blank-separated words) are summed per source.  Sources in code-point
order, null last, weigh 1, 2, 3, 1, 2, 3, ... and share the corpus total by
weight, but none may ask for more than ``cap`` times what it has: a capped
source's excess goes to the others by weight until no one is above.  The
level of that water-filling is found in closed form: with sources ordered by
cap / weight, those before some point are capped and the rest share what the
capped ones leave.

A document of a source with rate r = target / size is taken floor(r) times,
and once more if a hash of its id falls below r - floor(r); the hash is the
first 52 bits of ``md5(doc_id:seed)``, so reruns agree and any engine can
repeat it.  With ``apart``, rows whose id is null or another row's too hash
``md5(doc_id:sha256(text):seed)`` instead, so that a block of rows with one
id is not taken or left as a whole.

Skew: the per-source sums are map-side combined; rates (one row per source)
are joined back by Spark's own choice of join, so a source with a third of
all rows is either broadcast against or split by AQE.  So are the shared ids
of ``apart``, one row each, if there are any.

Defined results: null texts have size 0 and are never taken; a null source
is a source (the last); a null id is hashed as the empty string; a source
whose texts are all empty has target 0; rows that repeat an id (with ``apart``:
id and text) draw alike; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import spare_name, whole_text, word_count

CAP = 3
WEIGHTS = 3
SEED = "mix"


def source_rates(sized: DataFrame, cap: int = CAP, weights: int = WEIGHTS) -> DataFrame:
    """One row per source of ``sized`` (source, size): source, source_size, target."""
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    # One row per source from here on.
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everyone = Window.partitionBy(F.lit(0))
    weighed = sums.select(
        "source", "source_size",
        (1 + (F.row_number().over(by_name) - 1) % weights).cast("double").alias("weight"),
        F.sum("source_size").over(everyone).alias("total"))
    level = F.col("source_size") * cap / F.col("weight")
    earlier = (Window.partitionBy(F.lit(0)).orderBy(level, F.col("source").asc_nulls_last())
               .rowsBetween(Window.unboundedPreceding, -1))
    filled = weighed.select(
        "*", level.alias("own_level"),
        F.coalesce(F.sum(F.col("source_size") * cap).over(earlier), F.lit(0)).alias("capped_size"),
        F.coalesce(F.sum("weight").over(earlier), F.lit(0.0)).alias("capped_weight"),
        F.sum("weight").over(everyone).alias("all_weight"))
    # If all sources before this one are capped, the rest share what is left at this level.
    shared = (F.col("total") - F.col("capped_size")) / (F.col("all_weight") - F.col("capped_weight"))
    levels = filled.select("*", shared.alias("shared_level"), (F.col("own_level") <= shared).alias("full"))
    # The water is the shared level of the first source that is not full.  It is the highest of theirs
    # (behind it, sources count as capped that are not), whichever of tied sources comes first.
    first_free = F.max(F.when(~F.col("full"), F.col("shared_level"))).over(everyone)
    levels = levels.select("*", first_free.alias("water"))
    target = (F.when(F.col("full") | F.col("water").isNull(), (F.col("source_size") * cap).cast("double"))
              .otherwise(F.col("weight") * F.col("water")))
    return levels.select("source", "source_size", target.alias("target"))


def draw(key: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that only the key and the seed decide."""
    digest = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":" + seed)))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(2 ** 52))


def with_draw_key(docs: DataFrame, id_col: str, text_col: str, apart: bool) -> tuple[DataFrame, str]:
    """``docs`` with what each row's draw hashes, and that column's name."""
    name = spare_name(docs, "mix_draw")
    own = docs[id_col].cast("string")
    if not apart:
        return docs.withColumn(name, own), name
    with_text = F.concat(F.coalesce(own, F.lit("")), F.lit(":"), F.sha2(whole_text(docs[text_col]), 256))
    shared_name = spare_name(docs, "mix_shared")
    shared = (docs.filter(docs[id_col].isNotNull()).groupBy(docs[id_col].alias(shared_name))
              .agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(shared_name))
    if shared.isEmpty():
        return docs.withColumn(name, F.when(docs[id_col].isNull(), with_text).otherwise(own)), name
    found = docs.join(shared, docs[id_col] == shared[shared_name], "left")
    alone = docs[id_col].isNotNull() & shared[shared_name].isNull()
    return found.withColumn(name, F.when(alone, own).otherwise(with_text)).drop(shared_name), name


def with_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                cap: int = CAP, weights: int = WEIGHTS, seed: str = SEED,
                apart: bool = False) -> tuple[DataFrame, str]:
    """``docs`` with a struct column (size, source_size, target, copies), and that column's name."""
    name = spare_name(docs, "mix")
    keyed, draw_key = with_draw_key(docs, id_col, text_col, apart)
    sized = keyed.withColumn(name, word_count(keyed[text_col]))
    rates = source_rates(sized.select(F.col(source_col).alias("source"), F.col(name).alias("size")), cap, weights)
    key, size, target = (spare_name(sized, x) for x in ("mix_source", "mix_source_size", "mix_target"))
    rates = rates.select(F.col("source").alias(key), F.col("source_size").alias(size), F.col("target").alias(target))
    joined = sized.join(rates, sized[source_col].eqNullSafe(rates[key]))
    rate = F.when(F.col(size) > 0, F.col(target) / F.col(size)).otherwise(F.lit(0.0))
    copies = F.floor(rate) + (draw(F.col(draw_key), seed) < rate - F.floor(rate)).cast("long")
    return joined.withColumn(name, F.struct(
        F.col(name).alias("size"), F.col(size).alias("source_size"), F.col(target).alias("target"),
        F.least(copies, F.lit(cap).cast("long")).alias("copies"))).drop(key, size, target, draw_key), name


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """A row per document: doc_id, size, source_size, target, taken."""
    mixed, name = with_copies(docs.select("doc_id", "text", "source"), **options)
    return mixed.select("doc_id", f"{name}.size", f"{name}.source_size", f"{name}.target",
                        (F.col(f"{name}.size") * F.col(f"{name}.copies")).alias("taken"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns of ``docs``."""
    mixed, name = with_copies(docs, **options)
    copy = spare_name(mixed, "copy")
    times = F.sequence(F.lit(1).cast("long"), F.col(f"{name}.copies"))
    return (mixed.filter(F.col(f"{name}.copies") > 0).select("*", F.explode(times).alias(copy))
            .drop(name, copy))
