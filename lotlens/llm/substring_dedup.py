"""Substring dedup: a count-min prefilter, then exact grouping of the windows it cannot rule out.

A window is ``WINDOW`` consecutive words of one document.  Each word covered
by a window whose word sequence also starts in a document with a smaller id
is removed; windows are judged on the input.

*Prefilter.*  Documents are dealt into buckets of bounded size.  Each
bucket's count-min sketch (``DEPTH`` rows of ``2^bits`` cells) is kept sparse:
the sorted list of its occupied cells per row.  The sketches are merged by
cell range, each range in a task of its own, and each bucket gets back one
bit per cell it occupies: does another bucket occupy it too?  With its own
counts this tells whether the merged sketch counts a cell at least twice.
A window whose cells all are counted twice *may* repeat; one with a cell
counted once cannot.  Counts only overestimate, so none is lost.  No sketch is ever
broadcast or held whole, and its width follows the corpus, so the prefilter
works alike at every size.

*Exact pass.*  Only windows that may repeat are hashed for good (BLAKE2b, 128
bits of the words joined by one space) and grouped: per bucket a digest goes
out once, with its smallest id there; the grouping answers with one bit, is
there a smaller id elsewhere?  With its own smallest id the bucket knows
which of its windows to remove.

*Skew.*  A window in a third of all documents is one cell and one digest per
bucket, whatever the number of copies; buckets are dealt by row, not by id,
so an id that repeats is spread as well.

Defined results: null and empty texts have no words; a null id counts as
larger than any other (its text may be removed, never causes removal from
rows with an id); rows that share an id do not remove each other's windows; windows never
cross documents; an empty table gives an empty result; further columns,
whatever their names, are not looked at.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .buckets import (
    LEAST_BUCKET, REPLY_SCHEMA, Layout, arrow_table, bits_of, by_shard, dealt, distinct_rows, replies, split_ranges,
    text_bytes)
from .words import Words, blocks, find_words, mixed, window_hashes

WINDOW = 13
DEPTH = 2
DIGEST = 16
#: Cells per window in a sketch row, as a power of two.
SPARE_BITS = 3
NO_ID = np.iinfo(np.int64).max

SHARE_SCHEMA = "shard int, bucket int, data binary, ids binary"


class SketchLayout(Layout):
    """With the width of the sketch's rows, from about six bytes a word."""

    def __init__(self, total_bytes: int, least_bucket: int = LEAST_BUCKET) -> None:
        super().__init__(total_bytes, least_bucket)
        self.cell_bits = max(self.shard_bits + 1, (total_bytes // 6 + 1).bit_length() + SPARE_BITS)


def pack_gaps(values: np.ndarray) -> bytes:
    """A sorted list of distinct numbers as 16-bit gaps; 0xFFFF stands for a step of 65535 without a number."""
    gaps = np.diff(values.astype(np.int64), prepend=-1)
    long, rest = np.divmod(gaps, 0xFFFF)
    out = np.full(int(long.sum()) + len(gaps), 0xFFFF, dtype=np.uint16)
    out[np.cumsum(long + 1) - 1] = rest
    return out.tobytes()


def unpack_gaps(data: bytes) -> np.ndarray:
    gaps = np.frombuffer(data, dtype=np.uint16)
    return np.cumsum(gaps, dtype=np.int64)[gaps != 0xFFFF] - 1


def _occupied(hashes: np.ndarray, row: int, layout: SketchLayout) -> np.ndarray:
    """The cell of each window in one sketch row."""
    return mixed(hashes ^ np.uint64(row + 1)) >> np.uint64(64 - layout.cell_bits)


class Bucket:
    """The documents of one bucket and their window hashes."""

    def __init__(self, table: pa.Table, window: int) -> None:
        ids = table.column("doc_id")
        self.null = ids.is_null().to_numpy()
        self.ids = ids.fill_null(NO_ID).to_numpy()
        self.texts = [t.encode() for t in table.column("text").to_pylist()]
        self.window = window
        self.parts: list[tuple[int, Words]] = []
        hashes, owners, starts = [], [], []
        for a, b in blocks(self.texts):
            words = find_words(self.texts[a:b])
            h, whole = window_hashes(words, window)
            at = np.flatnonzero(whole)
            hashes.append(h[at])
            owners.append((np.searchsorted(words.first, at, side="right") - 1 + a).astype(np.int64))
            starts.append(at)
            self.parts.append((a, words))
        self.hashes = np.concatenate(hashes) if hashes else np.zeros(0, dtype=np.uint64)
        self.owners = np.concatenate(owners) if owners else np.zeros(0, dtype=np.int64)
        self.starts = starts

    def may_repeat(self, layout: SketchLayout, shared: dict[int, bytes]) -> np.ndarray:
        """Per window, whether the merged sketch counts it at least twice."""
        out = np.ones(len(self.hashes), dtype=bool)
        for row in range(DEPTH):
            cells, place, counts = np.unique(_occupied(self.hashes, row, layout),
                                             return_inverse=True, return_counts=True)
            twice = counts > 1
            for shard, a, b in split_ranges(cells, layout.cell_bits - layout.shard_bits):
                twice[a:b] |= bits_of(shared[(row << layout.shard_bits) + shard], b - a)
            out &= twice[place]
        return out

    def digests(self, chosen: np.ndarray) -> np.ndarray:
        """BLAKE2b of each chosen window's words joined by one space, as two big-endian numbers."""
        out, done = [], 0
        for (a, words), starts in zip(self.parts, self.starts, strict=True):
            mine = starts[chosen[done:done + len(starts)]]
            done += len(starts)
            if not len(mine):
                continue
            joined = b"\n".join([*self.texts[a:a + len(words.first) - 1], b""])
            # words one blank apart are hashed from a copy in which they all are
            single = joined if np.array_equal(words.starts[1:], words.ends[:-1] + 1) else None
            spans = words
            buffer = np.frombuffer(joined, dtype=np.uint8).copy()
            if single is None:
                lengths = words.ends - words.starts
                keep = np.zeros(len(buffer) + 1, dtype=bool)
                inside = np.zeros(len(buffer) + 1, dtype=np.int8)
                inside[words.starts] += 1
                inside[words.ends] -= 1
                keep[:] = np.cumsum(inside, dtype=np.int8) > 0
                keep[words.ends] = True
                buffer = np.append(buffer, np.uint8(32))[keep]
                ends = np.cumsum(lengths + 1) - 1
                spans = Words(words.hashes, ends - lengths, ends, words.first)
            buffer[spans.ends[spans.ends < len(buffer)]] = 32
            text = buffer.tobytes()
            first, last = spans.starts[mine].tolist(), spans.ends[mine + self.window - 1].tolist()
            blake = hashlib.blake2b
            out.append(b"".join([blake(text[s:e], digest_size=DIGEST).digest()
                                 for s, e in zip(first, last, strict=True)]))
        return np.frombuffer(b"".join(out), dtype=">u8").reshape(-1, 2).astype(np.uint64)


def _smallest(place: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    out = np.full(n, NO_ID, dtype=np.int64)
    np.minimum.at(out, place, ids)
    return out


def _digest_shards(distinct: np.ndarray, layout: SketchLayout) -> list[tuple[int, int, int]]:
    shift = np.uint64(64 - layout.cell_bits)
    return split_ranges(distinct[:, 0] >> shift, layout.cell_bits - layout.shard_bits)


def _sketch(layout: SketchLayout, window: int):
    def emit(table: pa.Table) -> pa.Table:
        bucket = Bucket(table, window)
        number = table.column("bucket")[0].as_py()
        rows = []
        for row in range(DEPTH):
            cells = np.unique(_occupied(bucket.hashes, row, layout))
            low = np.uint64((1 << (layout.cell_bits - layout.shard_bits)) - 1)
            rows += [((row << layout.shard_bits) + shard, number, pack_gaps(cells[a:b] & low), None)
                     for shard, a, b in split_ranges(cells, layout.cell_bits - layout.shard_bits)]
        return arrow_table(rows, SHARE_SCHEMA)
    return emit


def _merge_cells(layout: SketchLayout):
    def merge(table: pa.Table) -> pa.Table:
        """Merge the sketches of one cell range: a bit per bucket and cell, set if another bucket has it."""
        lists = [unpack_gaps(x) for x in table.column("data").to_pylist()]
        # counters of the range that stop at two (8 MB for 0.9 GB of text, 256 MB for 100 TB)
        counts = np.zeros(1 << (layout.cell_bits - layout.shard_bits), dtype=np.uint8)
        for cells in lists:
            counts[cells] = np.minimum(counts[cells] + 1, 2)
        return replies(table, "sketch", [counts[cells] > 1 for cells in lists])
    return merge


def _merge_digests(table: pa.Table) -> pa.Table:
    """Group the digests of one range: a bit per bucket and digest, set if another bucket has a smaller id."""
    lists = [np.frombuffer(x, dtype=np.uint64).reshape(-1, 2) for x in table.column("data").to_pylist()]
    ids = np.concatenate([np.frombuffer(x, dtype=np.int64) for x in table.column("ids").to_pylist()])
    distinct, place = distinct_rows(np.concatenate(lists))
    smaller = _smallest(place, ids, len(distinct))[place] < ids
    return replies(table, "digest", np.split(smaller, np.cumsum([len(x) for x in lists])[:-1]))


def _exact(layout: SketchLayout, window: int):
    def emit(table: pa.Table, answers: pa.Table) -> pa.Table:
        bucket = Bucket(table, window)
        chosen = bucket.may_repeat(layout, by_shard(answers, "sketch"))
        distinct, place = distinct_rows(bucket.digests(chosen))
        ids = _smallest(place, bucket.ids[bucket.owners[chosen]], len(distinct))
        number = table.column("bucket")[0].as_py()
        return arrow_table([(shard, number, distinct[a:b].tobytes(), ids[a:b].tobytes())
                       for shard, a, b in _digest_shards(distinct, layout)], SHARE_SCHEMA)
    return emit


OUT_SCHEMA = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string"


def _remove(layout: SketchLayout, window: int, with_text: bool):
    def emit(table: pa.Table, answers: pa.Table) -> pa.Table:
        bucket = Bucket(table, window)
        chosen = bucket.may_repeat(layout, by_shard(answers, "sketch"))
        distinct, place = distinct_rows(bucket.digests(chosen))
        owner_ids = bucket.ids[bucket.owners[chosen]]
        elsewhere = np.zeros(len(distinct), dtype=bool)
        bits = by_shard(answers, "digest")
        for shard, a, b in _digest_shards(distinct, layout):
            elsewhere[a:b] = bits_of(bits[shard], b - a)
        repeated = np.zeros(len(bucket.hashes), dtype=bool)
        repeated[np.flatnonzero(chosen)] = (elsewhere[place]
                                            | (_smallest(place, owner_ids, len(distinct))[place] < owner_ids))
        rows, done = [], 0
        for (a, words), starts in zip(bucket.parts, bucket.starts, strict=True):
            hit = starts[repeated[done:done + len(starts)]]
            done += len(starts)
            steps = np.zeros(len(words.hashes) + 1, dtype=np.int64)
            np.add.at(steps, hit, 1)
            np.add.at(steps, hit + window, -1)
            kept = np.cumsum(steps)[:-1] == 0
            for k in range(len(words.first) - 1):
                mine = kept[words.first[k]:words.first[k + 1]]
                own, n = bucket.texts[a + k].split(), int(mine.sum())
                text = b" ".join(own if n == len(own) else compress(own, mine))
                row = (None if bucket.null[a + k] else int(bucket.ids[a + k]), len(own), len(own) - n,
                       hashlib.sha256(text).hexdigest())
                rows.append((*row, text.decode()) if with_text else row)
        return arrow_table(rows, OUT_SCHEMA + ", kept string" * with_text)
    return emit


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                    with_text: bool = True, least_bucket: int = LEAST_BUCKET) -> DataFrame:
    """A row per document: doc_id, n_words, n_removed, kept_sha256 and, if asked for, the kept text."""
    layout = SketchLayout(text_bytes(docs, text_col), least_bucket)
    # The same shuffle of the texts serves all three passes over them.
    buckets = dealt(docs, layout, id_col, text_col).groupBy("bucket")
    sketch = (buckets.applyInArrow(_sketch(layout, window), SHARE_SCHEMA)
              .groupBy("shard").applyInArrow(_merge_cells(layout), REPLY_SCHEMA))
    exact = (buckets.cogroup(sketch.groupBy("bucket")).applyInArrow(_exact(layout, window), SHARE_SCHEMA)
             .groupBy("shard").applyInArrow(_merge_digests, REPLY_SCHEMA))
    return buckets.cogroup(sketch.unionByName(exact).groupBy("bucket")).applyInArrow(
        _remove(layout, window, with_text), OUT_SCHEMA + ", kept string" * with_text)
