"""Product-quantised vectors: k-means codebooks per part, nearest entries by slice-and-intersect bitmasks.

Components become integers (``floor(UNIT * x)``) and vectors are cut into ``PARTS`` equal parts, each with a
codebook of ``ENTRIES`` entries.  All arithmetic is in integers, so sums do not depend on the order of rows.

*Nearest entry* (``nearest``).  Per component of a part the entries' coordinates are kept sorted, with
*prefix masks*: the bit set of the entries among the first k.  A radius r selects a range of the sorted
coordinates around a vector's own; the two prefix masks at its borders, XORed, are the entries
within r in that component, and ANDed over the components the entries within r in all of them.
Every entry at a Euclidean distance of r or less is among these, so if the best of them is not further than r, it is the nearest
entry of all (equal distances go to the lower index).  Otherwise r grows to the distance of the best candidate, or
doubles while there is none, for the vectors concerned only.  Masks are words of 64 bits; larger
codebooks have several.

*Scale.*  The usable vectors are written once as packed integers.  Each round is one scan of them
that sends a sum and a count per part and entry and task (``PARTS`` x ``ENTRIES`` rows); the codebooks, whose size
is set by the parameters alone, pass through the driver.  No vector is shuffled.  The error of a label is an aggregate, written out before it is joined back, so
that Spark knows its size.

Defined results: vectors that are null or hold null or non-finite components are left out.  The vectors' length is that of the usable
vector with the smallest id (null ids last, then by its components) among those that ``PARTS`` divides and that are not empty; usable vectors of another
length keep their row, with null code and error (and add nothing to their label's).  Fewer vectors than entries give smaller
codebooks; an entry that no part uses stays.  Rows that repeat an id are coded one by one.  A component
beyond ``2^27 / UNIT`` is an error: its squared distances would leave 64 bits.  An empty table gives an
empty result; further columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialised

UNIT = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
#: Integer components must stay below this.
MOST = 1 << 27
#: Vectors that are coded at a time.
CHUNK = 8192


def _integers(unit: int):
    """(vec_id, label, n, ints): usable vectors as packed little-endian int32 components."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2).cast(pa.list_(pa.float64()))
            sizes = np.diff(lists.offsets.to_numpy())
            # a null list has no values of its own; a null component reads as NaN
            values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            sizes[batch.column(2).is_null().to_numpy(zero_copy_only=False)] = 0
            ends = np.cumsum(sizes)
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
            usable = (bad[ends] == bad[ends - sizes]) & batch.column(2).is_valid().to_numpy(zero_copy_only=False)
            with np.errstate(over="ignore", invalid="ignore"):
                scaled = np.floor(unit * values)
            if len(scaled) and (np.abs(scaled[np.isfinite(values)]) > MOST).any():
                raise ValueError(f"a component is beyond {MOST // unit}")
            ints = np.where(np.isfinite(scaled), scaled, 0).astype("<i4")
            rows = np.flatnonzero(usable)
            packed = [ints[ends[k] - sizes[k]:ends[k]].tobytes() for k in rows]
            keep = pa.array(rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(keep), batch.column(1).take(keep), pa.array(sizes[rows].astype(np.int32)),
                 pa.array(packed, pa.binary())], ["vec_id", "label", "n", "ints"])
    return read


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                    label_col: str = "label", unit: int = UNIT) -> DataFrame:
    """vec_id, label, n (components), ints (packed int32) of the usable rows of ``vectors``, written out."""
    label = vectors.schema[label_col].dataType
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("label", label),
                           T.StructField("n", T.IntegerType()), T.StructField("ints", T.BinaryType())])
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"),
                          F.col(vector_col).cast("array<double>").alias("vector"))
    return materialised(rows.mapInArrow(_integers(unit), schema), "integer-vectors")


class Slices:
    """Sorted coordinates and prefix masks of one part's codebook."""

    def __init__(self, book: np.ndarray) -> None:
        self.book = book.astype(np.int64)  # entry, component
        entries, width = book.shape
        self.words = -(-entries // 64)
        order = np.argsort(self.book, axis=0, kind="stable")
        self.coordinates = np.take_along_axis(self.book, order, axis=0).T.copy()
        bits = np.zeros((entries, self.words), dtype=np.uint64)
        bits[np.arange(entries), np.arange(entries) // 64] = np.uint64(1) << (np.arange(entries) % 64).astype(np.uint64)
        self.prefix = np.zeros((width, entries + 1, self.words), dtype=np.uint64)
        for j in range(width):
            self.prefix[j, 1:] = np.bitwise_or.accumulate(bits[order[:, j]], axis=0)
        self.radius = self._first_radius()

    def _first_radius(self) -> int:
        """Half the root mean square distance of neighbouring entries, at least 1."""
        square = [int(((self.book - e) ** 2).sum(axis=1)[np.arange(len(self.book)) != k].min())
                  for k, e in enumerate(self.book) if len(self.book) > 1]
        return max(1, int(np.sqrt(np.mean(square)) / 2)) if square else 1

    def within(self, x: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Masks (a row of words per vector) of the entries within ``radius`` in every component."""
        mask = np.full((len(x), self.words), ~np.uint64(0))
        for j, sorted_values in enumerate(self.coordinates):
            low = np.searchsorted(sorted_values, x[:, j] - radius, side="left")
            high = np.searchsorted(sorted_values, x[:, j] + radius, side="right")
            mask &= self.prefix[j, high] ^ self.prefix[j, low]
        return mask

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of each vector's nearest entry, the lower index of equal ones."""
        best = np.zeros(len(x), dtype=np.int64)
        error = np.full(len(x), np.iinfo(np.int64).max)
        radius = np.full(len(x), self.radius, dtype=np.int64)
        todo = np.arange(len(x))
        while len(todo):
            mask = self.within(x[todo], radius[todo])
            error[todo] = np.iinfo(np.int64).max
            for e, entry in enumerate(self.book):
                has = todo[(mask[:, e // 64] >> np.uint64(e % 64) & np.uint64(1)).astype(bool)]
                distance = ((x[has] - entry) ** 2).sum(axis=1)
                nearer = distance < error[has]
                best[has[nearer]], error[has[nearer]] = e, distance[nearer]
            found = error[todo] < np.iinfo(np.int64).max
            reach = np.where(found, np.ceil(np.sqrt(np.where(found, error[todo], 0).astype(np.float64))).astype(np.int64) + 1, 0)
            open_ = ~found | (error[todo] > radius[todo] ** 2)
            radius[todo] = np.where(found, reach, 2 * radius[todo])
            todo = todo[open_]
        return best, error


def _parts(batch: pa.RecordBatch, column: int, length: int, parts: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(from, to, vectors by part and component) of a batch of vectors of the right length, a chunk at a time."""
    for a in range(0, batch.num_rows, CHUNK):
        packed = batch.column(column)[a:a + CHUNK].to_pylist()
        ints = np.frombuffer(b"".join(packed), dtype="<i4").astype(np.int64)
        yield a, a + len(packed), ints.reshape(len(packed), parts, length // parts)


def _sums(books: np.ndarray):
    """(part, entry, n, sums) of the vectors of a task by their nearest entries."""
    parts, entries, width = books.shape

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = [Slices(b) for b in books]
        counts = np.zeros((parts, entries), dtype=np.int64)
        sums = np.zeros(books.shape, dtype=np.int64)
        for batch in batches:
            for _, _, x in _parts(batch, 0, parts * width, parts):
                for p in range(parts):
                    best, _ = slices[p].nearest(x[:, p])
                    counts[p] += np.bincount(best, minlength=entries)
                    for j in range(width):  # a chunk's sums are below 2^53, so exact
                        sums[p, :, j] += np.bincount(best, weights=x[:, p, j], minlength=entries).astype(np.int64)
        used = np.argwhere(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used[:, 0].astype(np.int32)), pa.array(used[:, 1].astype(np.int32)),
             pa.array(counts[counts > 0]), pa.array(list(sums[counts > 0]), pa.list_(pa.int64()))],
            ["part", "entry", "n", "sums"])
    return read


def first_books(vectors: DataFrame, length: int, parts: int = PARTS, entries: int = ENTRIES) -> np.ndarray:
    """Codebooks (part, entry, component) of the vectors with the smallest ids, in order."""
    chosen = (vectors.filter(F.col("n") == length).select("vec_id", "ints")
              .orderBy(F.asc_nulls_last("vec_id"), "ints").limit(entries).collect())  # ENTRIES rows
    books = np.array([np.frombuffer(bytes(r.ints), dtype="<i4") for r in chosen], dtype=np.int64)
    return books.reshape(len(chosen), parts, -1).transpose(1, 0, 2).copy()


def trained_books(vectors: DataFrame, books: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """``books`` after so many rounds over the packed ``vectors``; every entry moves to the floored mean of its parts."""
    parts, _, width = books.shape
    of_length = vectors.filter(F.col("n") == parts * width).select("ints")
    for _ in range(rounds):
        totals = (of_length.mapInArrow(_sums(books), "part int, entry int, n bigint, sums array<bigint>")
                  .groupBy("part", "entry")
                  .agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[j]).alias(f"s{j}") for j in range(width)]))
        books = books.copy()
        for r in totals.collect():  # PARTS x ENTRIES rows
            books[r.part, r.entry] = [r[f"s{j}"] // r.n for j in range(width)]
    return books


def _coded(books: np.ndarray):
    parts, _, width = books.shape

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = [Slices(b) for b in books]
        for batch in batches:
            codes, errors = [], []
            for a, b, x in _parts(batch, 2, parts * width, parts):
                best, error = zip(*[slices[p].nearest(x[:, p]) for p in range(parts)], strict=True)
                codes += ["".join(f"{e:02x}" for e in row) for row in np.stack(best, axis=1).tolist()]
                errors.append(np.sum(error, axis=0))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(codes, pa.string()),
                 pa.array(np.concatenate(errors) if errors else np.zeros(0, dtype=np.int64))],
                ["vec_id", "label", "code", "error"])
    return read


def books_digest(books: np.ndarray) -> str:
    """SHA-256 (hex) of all entries' components in decimal, by part, entry and place, comma-joined."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def vector_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                 parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, unit: int = UNIT) -> DataFrame:
    """A row per usable vector: vec_id, label, code, error, label_error, codebooks_sha256."""
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits: 1 to 256 entries")
    packed = integer_vectors(vectors, id_col, vector_col, label_col, unit)
    whole = packed.filter((F.col("n") > 0) & (F.col("n") % parts == 0))
    first = whole.orderBy(F.asc_nulls_last("vec_id"), "n", "ints").select("n").head()
    schema = T.StructType([*packed.schema.fields[:2], T.StructField("code", T.StringType()),
                           T.StructField("error", T.LongType())])
    if first is None:
        books = np.zeros((parts, 0, 0), dtype=np.int64)
        coded = packed.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    else:
        books = trained_books(packed, first_books(packed, first.n, parts, entries), rounds)
        coded = (packed.filter(F.col("n") == first.n).select("vec_id", "label", "ints")
                 .mapInArrow(_coded(books), schema)
                 .unionByName(packed.filter(F.col("n") != first.n).select(
                     "vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))))
        coded = materialised(coded, "codes")
    by_label = materialised(coded.groupBy(F.col("label").alias("of_label")).agg(F.sum("error").alias("label_error")), "label-errors")
    return (coded.join(by_label, coded["label"].eqNullSafe(by_label["of_label"]), "left")
            .select("vec_id", "label", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256")))


def decoded(code: str, books: np.ndarray, unit: int = UNIT) -> np.ndarray:
    """The vector (approximately, in the input's unit) that a code stands for."""
    entries = [int(code[k:k + 2], 16) for k in range(0, len(code), 2)]
    return np.concatenate([books[p, e] for p, e in enumerate(entries)]) / unit
