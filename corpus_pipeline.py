"""Corpus pipeline: from raw documents to the shards of a training mix.

Stages, each on all that the one before kept, with a written table between them:

1. ``quality``          documents that the rule ensemble rejects go
2. ``near_duplicates``  one document of each group of copies and near copies stays
3. ``decontamination``  documents that hold a benchmark window go, each judged by its own text
4. ``mixing``           each document as often as its source's target wants it
5. ``sharding``         a shard and a gapless slot for every copy

All but the last return the columns of ``documents``.

What each stage does with awkward rows (further columns, whatever their names, are kept and not looked at):

* ``quality``: a null text scores as the empty one (all statistics 0); a null label is none; an id with several
  labels counts by their mean; equal texts get equal scores, and a score of just the cut is kept; rows that
  repeat stay as often as they are; no labels, or labels of one class, make one score for all; no documents stay none.
* ``near_duplicates``: null and empty texts are one group of copies; texts without words are linked to nothing else; the
  smallest id of a group stays (null ids last, the smaller digest of the text on ties); of rows that repeat an id and
  a text one stays; a text of fewer than five words is one shingle; no documents stay none.
* ``decontamination``: null and empty texts hold nothing and stay; each row is judged by its own text, so rows
  that share an id with a contaminated one stay, and rows that repeat one go with it; empty items match nothing; without
  documents or items nothing goes.
* ``mixing``: a null text has size 0; a null source is one of its own, the last; rows of one id and text draw
  alike, other rows of that id draw by themselves; sources that tie get targets by their order; sources
  of size 0 are not taken; no documents make no mix.
* ``sharding``: a null text has no bytes (and the CRC of none); rows without id share a shard; equal rows get slots one after
  the other; very long texts count by their bytes like any other; no documents have no shards.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lotlens.llm import decontam, jaccard_join, mixing, quality, sharding
from lotlens.llm.common import materialised, read_table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, quality.train(docs, read_table(spark, sf_dir, "labels")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean_rows(docs, read_table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, apart=True)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: Training and near duplicates are beyond SQL; tests/llm compares every stage with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialised(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
