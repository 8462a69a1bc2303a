"""Documents dealt into buckets that exchange packed lists with ranges of a key space.

A pass over the texts runs per bucket (a group of documents of bounded size).
What a bucket says about its documents goes out as one packed, sorted list per
range of the key space; a range's task merges the lists of all buckets and
answers each with bits in the list's own order.  Buckets and ranges both
grow with the square root of the corpus, until buckets hold ``MOST_BUCKET`` bytes; from there on their
numbers grow with the corpus, and lists get shorter.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_text

#: Buckets hold about the square root of (corpus bytes x this), within the bounds: as many bytes
#: of text to a bucket as there are buckets, times this.
BALANCE = 1 << 14
LEAST_BUCKET, MOST_BUCKET = 1 << 20, 64 << 20

REPLY_SCHEMA = "bucket int, shard int, kind string, data binary"

_ARROW = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}


class Layout:
    """Numbers of buckets and (a power of two) of ranges for a corpus of so many bytes."""

    def __init__(self, total_bytes: int, least_bucket: int = LEAST_BUCKET) -> None:
        size = min(max(math.isqrt(total_bytes * BALANCE), least_bucket), MOST_BUCKET)
        self.total_bytes = total_bytes
        self.buckets = max(1, -(-total_bytes // size))
        self.shard_bits = (self.buckets - 1).bit_length()


def text_bytes(docs: DataFrame, text_col: str) -> int:
    """UTF-8 bytes of all texts."""
    return docs.agg(F.sum(F.octet_length(whole_text(text_col)).cast("long"))).first()[0] or 0


def dealt(docs: DataFrame, layout: Layout, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text, bucket: rows are dealt by position, so that ids and texts that repeat are spread."""
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), whole_text(text_col).alias("text"),
                       F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(layout.buckets))
                       .cast("int").alias("bucket"))


def split_ranges(sorted_keys: np.ndarray, low_bits: int) -> list[tuple[int, int, int]]:
    """(range, from, to) of sorted numbers; a range is what the bits above ``low_bits`` say."""
    if not len(sorted_keys):
        return []
    shards = (sorted_keys >> np.uint64(low_bits)).astype(np.int64)
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(shards)) + 1, [len(shards)]])
    return [(int(shards[a]), int(a), int(b)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def distinct_rows(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct rows of numbers, and the place of each row among them."""
    order = np.lexsort(rows.T[::-1])
    ranked = rows[order]
    new = np.ones(len(ranked), dtype=bool)
    new[1:] = (ranked[1:] != ranked[:-1]).any(axis=1)
    place = np.empty(len(ranked), dtype=np.int64)
    place[order] = np.cumsum(new) - 1
    return ranked[new], place


def bits_of(data: bytes, n: int) -> np.ndarray:
    """The first ``n`` bits as booleans."""
    return np.unpackbits(np.frombuffer(data, dtype=np.uint8), count=n).view(bool)


def replies(table: pa.Table, kind: str, bits: list[np.ndarray]) -> pa.Table:
    """An answer of ``kind`` to each of the buckets whose lists a range's ``table`` holds."""
    shard = table.column("shard")[0].as_py()
    rows = [(bucket, shard, kind, np.packbits(b).tobytes())
            for bucket, b in zip(table.column("bucket").to_pylist(), bits, strict=True)]
    return arrow_table(rows, REPLY_SCHEMA)


def arrow_table(rows: list[tuple], schema: str) -> pa.Table:
    """Rows as an Arrow table of a Spark schema string."""
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    return pa.table({name: pa.array(c, _ARROW[kind]) for c, (name, kind) in zip(columns, fields, strict=True)})


def by_shard(answers: pa.Table, kind: str) -> dict[int, bytes]:
    """The answers of ``kind`` that a bucket got, by range."""
    return {s: d for s, k, d in zip(answers.column("shard").to_pylist(), answers.column("kind").to_pylist(),
                                    answers.column("data").to_pylist(), strict=True) if k == kind}
