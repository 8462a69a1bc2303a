"""Exact dedup by skew-safe combining: local, salted, global; full content compared at every stage.

Texts are equal when identical after no change (null counts as empty).  Of
equal texts the row with the largest ``doc_id`` stays.

* *Local + salted*: rows are grouped by (digest, salt, content).  Spark's
  partial aggregation is the local stage: each input task combines its equal
  texts before anything moves, so a group that holds a third of all rows
  sends at most one row per task and salt.
* *Global*: the salt winners are grouped by (digest, content).
* The content itself is a grouping key of both stages, so two texts with one
  digest are never merged.  Members find their group by digest; only texts
  whose digest is shared by different contents (none, short of a SHA-256
  collision) are then joined by content.

Defined results: null ``doc_id`` ranks below every id; rows that repeat the
same (``doc_id``, text) are members of their own, of which one is kept; an
empty table gives an empty result; further columns of the input, whatever
their names, are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialised, whole_text

#: Parts that a digest group is spread over in the second stage.
SALTS = 16


def content_digest(text_col: str) -> Column:
    """SHA-256 of the text in UTF-8, as 32 bytes."""
    return F.unhex(F.sha2(whole_text(text_col), 256))


def content_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   salts: int = SALTS) -> DataFrame:
    """One row per distinct content: digest, content, keep_id, group_size."""
    rows = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("content"))
    rows = rows.select("id", "content", content_digest("content").alias("digest"),
                       F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int").alias("salt"))
    salted = rows.groupBy("digest", "salt", "content").agg(
        F.max("id").alias("winner"), F.count(F.lit(1)).alias("members"))
    return salted.groupBy("digest", "content").agg(
        F.max("winner").alias("keep_id"), F.sum("members").alias("group_size"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                salts: int = SALTS) -> DataFrame:
    """A row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    groups = content_groups(docs, id_col, text_col, salts)
    # A digest names its content unless several contents share it.  Written out: read twice below.
    by_digest = materialised(groups.groupBy("digest").agg(
        F.count(F.lit(1)).alias("contents"), F.max("keep_id").alias("keep_id"),
        F.max("group_size").alias("group_size")), "content-groups")
    members = (docs.select(F.col(id_col).alias("doc_id"), content_digest(text_col).alias("digest"))
               .groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("copies"))
               .join(by_digest, "digest"))
    plain = members.filter("contents = 1").select("doc_id", "digest", "keep_id", "group_size", "copies")
    clashing = by_digest.filter("contents > 1").select("digest")
    if clashing.isEmpty():
        return _member_rows(plain)
    by_content = (docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("content"))
                  .withColumn("digest", content_digest("content"))
                  .join(clashing, "digest", "left_semi")
                  .groupBy("doc_id", "digest", "content").agg(F.count(F.lit(1)).alias("copies"))
                  .join(groups, ["digest", "content"])
                  .select("doc_id", "digest", "keep_id", "group_size", "copies"))
    return _member_rows(plain.unionByName(by_content))


def _member_rows(members: DataFrame) -> DataFrame:
    copy = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")
    return members.select("*", copy).select(
        "doc_id", "keep_id", "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))
