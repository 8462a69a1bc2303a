"""Target-distribution importance resampling with n-gram buckets from prefix CRCs.

Documents are bags of ``1..N`` word n-grams, hashed by CRC-32 into ``BUCKETS``
buckets.  A bucket's *gain* is the scaled log ratio of its (smoothed) share in
the target texts to that in the corpus; a document's weight is the sum of the
gains of its n-grams, and adding Gumbel noise to the weights and taking
the highest draws documents without replacement in proportion to their weights.

*Method.*  A block of documents is normalised once (lower case, a single space for
every run of separators) and scanned once; the running CRC registers give the
CRC of any n-gram by two look-ups and a GF(2) shift (``prefix_crc``).  No n-gram is ever made as a string.

*Scale.*  Two passes over the texts, neither of which shuffles them: the first sends
at most ``BUCKETS`` counts per task, the second adds up gains and writes a
row of numbers per document.  The gains (``BUCKETS`` numbers, whatever the corpus) pass through the driver.
Ranks come from a range sort of those rows: a row's rank is its place in its
partition and the sizes of the partitions before it.  The sort key ends with a random number, so rows that agree
in all else are spread too.

Defined results: null and empty texts, and texts without words, have no features, weight 0 and
are never drawn; a null id counts as empty in the noise and comes last among equal scores; rows that share an
id share its noise; rows that repeat id and text are drawn one by one, in any order; without target texts
(or documents) the ratio is that of the smoothing alone; an empty table gives an empty result;
further columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialised, partitions_for, spare_name, whole_text
from .prefix_crc import piece_crcs, running_registers
from .words import blocks

GRAMS = 3
BUCKETS = 10_000
SCALE = 1000
SEED = 42
PERCENT = 5
LEAST_WORDS = 20


def _normalising_table() -> bytes:
    """Letters A-Z to lower case, everything that is not of a word to a space."""
    table = bytearray(range(256))
    for b in range(0x80):
        if not (0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A):
            table[b] = b + 0x20 if 0x41 <= b <= 0x5A else 0x20
    return bytes(table)


NORMALISE = _normalising_table()


class Grams(NamedTuple):
    """Buckets of the n-grams that begin at each word of a block of texts."""

    first: np.ndarray  # per text, the index of its first word; one more at the end
    buckets: list[tuple[np.ndarray, np.ndarray]]  # per n: words that an n-gram begins at, and its bucket


def gram_buckets(texts: list[bytes], grams: int = GRAMS, buckets: int = BUCKETS) -> Grams:
    raw = np.frombuffer(b"\n".join([*texts, b""]).translate(NORMALISE), dtype=np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    inside = raw != 0x20
    edges = np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    first = np.searchsorted(starts, offsets)
    kept = inside.copy()
    kept[ends] = True  # a single separator behind each word; the last byte is one
    # each word moves down by the separators dropped before it
    lengths = ends - starts
    starts = np.cumsum(lengths + 1) - (lengths + 1)
    ends = starts + lengths
    registers = running_registers(raw[kept].tobytes())
    last = np.repeat(first[1:], np.diff(first))
    found, at = [], np.arange(len(starts))
    for n in range(1, grams + 1):
        begin = at[at + n <= last]
        crcs = piece_crcs(registers, starts[begin], ends[begin + n - 1])
        found.append((begin, crcs % np.uint32(buckets)))
    return Grams(first, found)


def _count_buckets(grams: int, buckets: int):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            texts = [t.encode() for t in batch.column(0).to_pylist()]
            for a, b in blocks(texts):
                for _, bucket in gram_buckets(texts[a:b], grams, buckets).buckets:
                    counts += np.bincount(bucket, minlength=buckets)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(counts[used])], ["bucket", "n"])
    return read


def bucket_counts(rows: DataFrame, text_col: str = "text", grams: int = GRAMS, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): n-grams of all whole texts of ``rows`` by bucket."""
    return (rows.select(whole_text(text_col).alias("text"))
            .mapInArrow(_count_buckets(grams, buckets), "bucket int, n bigint")
            .groupBy("bucket").agg(F.sum("n").alias("n")))


def bucket_gains(docs: DataFrame, target: DataFrame, text_col: str = "text", grams: int = GRAMS,
                 buckets: int = BUCKETS, scale: int = SCALE) -> DataFrame:
    """(bucket, gain) for every bucket: scaled, floored log ratio of the smoothed shares, target to corpus."""
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = (every.join(bucket_counts(docs, text_col, grams, buckets).withColumnRenamed("n", "s"), "bucket", "left")
            .join(bucket_counts(target, text_col, grams, buckets).withColumnRenamed("n", "t"), "bucket", "left")
            .fillna(0, ["s", "t"]))
    both = materialised(both, "bucket-counts")
    total = {c: both.agg(F.sum(c).cast("double")).scalar() for c in ("s", "t")}
    ratio = ((F.col("t").cast("double") + 1) * (total["s"] + buckets)
             / ((F.col("s").cast("double") + 1) * (total["t"] + buckets)))
    return both.select("bucket", F.floor(scale * F.log(ratio)).cast("long").alias("gain"))


def _weigh(gains: np.ndarray, grams: int):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.encode() for t in batch.column(1).to_pylist()]
            for a, b in blocks(texts):
                found = gram_buckets(texts[a:b], grams, len(gains))
                words = np.diff(found.first)
                sums = np.zeros(found.first[-1] + 1, dtype=np.int64)
                for begin, bucket in found.buckets:
                    sums[begin + 1] += gains[bucket]
                sums = np.cumsum(sums)
                features = sum(np.maximum(words - n, 0) for n in range(grams))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b], pa.array([hashlib.sha256(t).digest() for t in texts[a:b]], pa.binary()),
                     pa.array(words.astype(np.int64)), pa.array(features.astype(np.int64)),
                     pa.array(sums[found.first[1:]] - sums[found.first[:-1]])],
                    ["doc_id", "digest", "n_words", "n_features", "weight"])
    return read


def importance_weights(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       grams: int = GRAMS, buckets: int = BUCKETS, scale: int = SCALE) -> DataFrame:
    """A row per document: doc_id, digest (SHA-256 of the text), n_words, n_features, weight."""
    table = bucket_gains(docs, target, text_col, grams, buckets, scale)
    gains = np.zeros(buckets, dtype=np.int64)
    for r in table.collect():  # a row per bucket, however large the corpus
        gains[r.bucket] = r.gain
    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
            .mapInArrow(_weigh(gains, grams), "doc_id bigint, digest binary, n_words bigint, n_features bigint, weight bigint"))


def ranked(rows: DataFrame, *order) -> DataFrame:
    """``rows`` with ``rank`` (1, 2, 3 ... in the given order), without bringing them to one place."""
    spread = rows.repartitionByRange(partitions_for(rows.sparkSession), *order).sortWithinPartitions(*order)
    placed = materialised(spread.withColumn("place", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("place", 33)  # the id holds the partition above 33 bits of the row's place in it
    sizes = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    # a row per partition
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return (placed.join(F.broadcast(before), part == before["part"])
            .withColumn("rank", F.col("before") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) + 1)
            .drop("place", "part", "before"))


def drawn(weights: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED,
          scale: int = SCALE) -> DataFrame:
    """``weights`` with score (weight and Gumbel noise of the id) and rank: ``percent`` of the documents of
    ``least_words`` or more, those of the highest scores; null for the others."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-scale * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    scored = materialised(weights.withColumn("score", F.col("weight") + noise)
                          .withColumn("spread", F.xxhash64(F.monotonically_increasing_id())), "scored")
    able = F.col("n_words") >= least_words
    in_order = ranked(scored.filter(able), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("spread"))
    most = F.floor(scored.filter(able).agg(F.count(F.lit(1)) * percent).scalar() / 100)
    return (in_order.withColumn("rank", F.when(F.col("rank") <= most, F.col("rank")))
            .unionByName(scored.filter(~able).withColumn("rank", F.lit(None).cast("long"))).drop("spread"))


def importance_resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                        percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """Every document: doc_id, n_features, weight, score, rank (null if not drawn), n_words."""
    weights = importance_weights(docs, target, id_col, text_col)
    return drawn(weights, percent, least_words, seed).select("doc_id", "n_features", "weight", "score", "rank", "n_words")


def resampled(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """The drawn documents, with all their columns, in no order.

    Rows that repeat an id and a text are one document here, returned (as any one of them) once for each of them that was drawn.
    """
    id_name, digest_name, times_name = (spare_name(docs, n) for n in ("drawn_id", "drawn_digest", "drawn_times"))
    chosen = (drawn(importance_weights(docs, target, id_col, text_col), percent, least_words, seed).filter("rank is not null")
              .groupBy(F.col("doc_id").alias(id_name), F.col("digest").alias(digest_name))
              .agg(F.count(F.lit(1)).cast("int").alias(times_name)))
    digest = F.unhex(F.sha2(whole_text(docs[text_col]), 256))
    found = docs.join(chosen, docs[id_col].cast("long").eqNullSafe(chosen[id_name]) & (digest == chosen[digest_name]))
    once = found.dropDuplicates([id_name, digest_name])
    return once.withColumn(times_name, F.explode(F.sequence(F.lit(1), F.col(times_name)))).select(*docs.columns)
