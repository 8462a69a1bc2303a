"""Suffix-array dedup: bytes covered by a ``LENGTH``-byte string that also starts elsewhere are removed.

Texts are UTF-8 bytes; strings never cross documents, may overlap, may be in
the same document, and are judged on the input.

*Shards.*  A suffix array of the whole corpus would be one huge object.  Here
every ``LENGTH``-byte string is dealt by its *anchor*: the smallest hash among its
``GRAM``-byte grams.  Equal strings have equal anchors, so each anchor's strings
can be sorted by themselves.  Neighbouring strings with one anchor form a
*segment* (a stretch of text of at most 2 * LENGTH - GRAM bytes).

1. Per bucket of documents, segments are cut.  Their digests (BLAKE2b, 128
   bits) go to ranges of digests, and one entry per anchor (a digest, the
   number of different segments) to the anchor's range.
2. A range of digests answers whether a segment occurs twice as a whole (all
   its strings repeat), and which bucket is to send its text (once); a range of
   anchors, whether an anchor has different segments, so that texts have to be
   compared, and whether in one place or dealt out.
3. The texts of such segments meet in their range: a suffix array by induced
   sorting and the permuted common prefixes tell which strings repeat.
4. Buckets gather the answers and cut the documents.

Most text has anchors that occur once, or segments that repeat as a whole;
only the ends of repeated passages are ever sent as text.

*Skew.*  Copies of a segment are one digest per bucket and one text in all.
An anchor with more than ``MOST_SEGMENTS`` segments, different within their
bucket (a passage within very many different texts), is one entry per bucket in
its range and not sorted in one place: its segments' digests are dealt out by
themselves, as all are, and so are those of its strings, which are counted, exactly.

Defined results: null and empty texts have no bytes; a text shorter than
``LENGTH`` loses nothing; rows that repeat a text lose it all (each copy starts
elsewhere too); null ids are passed through; an empty table gives an
empty result; further columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .buckets import (
    LEAST_BUCKET, REPLY_SCHEMA, Layout, arrow_table, bits_of, by_shard, dealt, distinct_rows, replies, split_ranges,
    text_bytes)
from .suffix_array import permuted_lcp, suffix_array
from .words import BYTE_BASE, blocks, mixed, powers

LENGTH = 400
GRAM = 128
MOST_SEGMENTS = 2048
DIGEST = 16
#: Bytes of segments that are sorted at once (more if one anchor has more).
SORT_BYTES = 2 << 20
#: Low bits of an ordering value that hold the position.
PLACE_BITS = 30

SEGMENT_SCHEMA = "shard int, bucket int, data binary, counts binary"
STRING_SCHEMA = "shard int, bucket int, kind string, data binary, about binary"
OUT_SCHEMA = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def cut_segments(buffer: np.ndarray, doc_ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Starts, numbers of strings and anchors of the segments of several texts in one buffer."""
    n = len(buffer)
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64),
                           np.cumsum((buffer.astype(np.uint64) + np.uint64(1)) * powers(BYTE_BASE, n))])
    hashes = mixed((sums[gram:] - sums[:-gram]) * powers(pow(BYTE_BASE, -1, 1 << 64), n - gram + 1))
    places = np.arange(len(hashes), dtype=np.uint64)
    # smallest of length - gram + 1 neighbours, the leftmost of equal ones, by doubling the stretch
    least = (hashes >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)) | places
    stretch, width = 1, length - gram + 1
    while 2 * stretch <= width:
        least = np.minimum(least[:-stretch], least[stretch:])
        stretch *= 2
    rest = width - stretch
    least = np.minimum(least[:len(least) - rest], least[rest:])
    own_end = np.repeat(doc_ends, np.diff(doc_ends, prepend=0))[:len(least)]
    starts = np.flatnonzero(np.arange(len(least)) + length <= own_end)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    anchors = (least[starts] & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (anchors[1:] != anchors[:-1]) | (starts[1:] != starts[:-1] + 1)]))
    # smallest hashes are small: mixed again, they spread over the ranges
    return starts[first], np.diff(np.append(first, len(starts))), mixed(hashes[anchors[first]])


class Bucket:
    """The documents of one bucket and their segments."""

    def __init__(self, table: pa.Table, length: int, gram: int) -> None:
        self.length = length
        self.number = table.column("bucket")[0].as_py()
        self.ids = table.column("doc_id").to_pylist()
        self.texts = [t.encode() for t in table.column("text").to_pylist()]
        self.blocks, parts, digests = [], [], []
        for a, b in blocks(self.texts):
            joined = b"".join(self.texts[a:b])
            ends = np.cumsum([len(t) for t in self.texts[a:b]])
            starts, runs, anchors = cut_segments(np.frombuffer(joined, dtype=np.uint8), ends, length, gram)
            parts.append((np.full(len(starts), len(self.blocks)), starts, runs, anchors))
            self.blocks.append((a, b, joined, ends))
            digests += [hashlib.blake2b(joined[s:e], digest_size=DIGEST).digest()
                        for s, e in zip(starts.tolist(), (starts + runs + length - 1).tolist(), strict=True)]
        empty = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
        self.block, self.starts, self.runs, anchors = (
            np.concatenate(x) for x in zip(empty, *parts, strict=True)) if parts else empty
        content = np.frombuffer(b"".join(digests), dtype=np.uint64).reshape(-1, 2)
        self.distinct, self.place = distinct_rows(np.column_stack([anchors, content]))
        self.example = np.zeros(len(self.distinct), dtype=np.int64)
        self.example[self.place[::-1]] = np.arange(len(self.place))[::-1]
        self.by_digest = np.lexsort((self.distinct[:, 2], self.distinct[:, 1]))
        new = np.ones(len(self.distinct), dtype=bool)
        new[1:] = self.distinct[1:, 0] != self.distinct[:-1, 0]
        self.first, self.anchor = np.flatnonzero(new), np.cumsum(new) - 1

    def ranges(self, layout: Layout) -> list[tuple[int, int, int]]:
        return split_ranges(self.distinct[:, 0] >> np.uint64(1), 63 - layout.shard_bits)

    def digest_ranges(self, layout: Layout) -> list[tuple[int, int, int]]:
        """As ``ranges``, of the segments in the order of their digests; numbered after those of the anchors."""
        return [((1 << layout.shard_bits) + shard, a, b) for shard, a, b in split_ranges(
            self.distinct[self.by_digest, 1] >> np.uint64(1), 63 - layout.shard_bits)]

    def anchor_ranges(self, layout: Layout) -> list[tuple[int, int, int]]:
        """As ``ranges``, of the different anchors."""
        return split_ranges(self.distinct[self.first, 0] >> np.uint64(1), 63 - layout.shard_bits)

    def answers(self, layout: Layout, table: pa.Table, kind: str) -> np.ndarray:
        """The bit of ``kind`` (whole, sender) of each distinct segment."""
        bits = by_shard(table, kind)
        out = np.zeros(len(self.distinct), dtype=bool)
        for shard, a, b in self.digest_ranges(layout):
            out[self.by_digest[a:b]] = bits_of(bits[shard], b - a)
        return out

    def to_send(self, layout: Layout, table: pa.Table, kind: str) -> np.ndarray:
        """Whether this bucket sends a distinct segment, and its anchor's are to be treated by ``kind`` (sort, deal)."""
        bits = by_shard(table, kind)
        anchors = np.zeros(len(self.first), dtype=bool)
        for shard, a, b in self.anchor_ranges(layout):
            anchors[a:b] = bits_of(bits[shard], b - a)
        return anchors[self.anchor] & self.answers(layout, table, "sender")

    def text(self, segment: int) -> bytes:
        start = self.starts[segment]
        return self.blocks[self.block[segment]][2][start:start + self.runs[segment] + self.length - 1]

    def string_digests(self, distinct: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Digests of all strings of some distinct segments, in order, and their numbers per segment."""
        out, runs = [], []
        for e in self.example[distinct].tolist():
            text, run = self.text(e), int(self.runs[e])
            runs.append(run)
            out += [hashlib.blake2b(text[k:k + self.length], digest_size=DIGEST).digest() for k in range(run)]
        return np.frombuffer(b"".join(out), dtype=np.uint64).reshape(-1, 2), np.array(runs, dtype=np.int64)


def _segments(layout: Layout, length: int, gram: int):
    def emit(table: pa.Table) -> pa.Table:
        bucket = Bucket(table, length, gram)
        twice = (np.bincount(bucket.place, minlength=len(bucket.distinct)) > 1)[bucket.by_digest]
        digests = bucket.distinct[bucket.by_digest, 1:]
        rows = [(shard, bucket.number, digests[a:b].tobytes(), np.packbits(twice[a:b]).tobytes())
                for shard, a, b in bucket.digest_ranges(layout)]
        sizes = np.diff(np.append(bucket.first, len(bucket.distinct)))
        anchors = np.column_stack([bucket.distinct[bucket.first], sizes.astype(np.uint64)])
        rows += [(shard, bucket.number, anchors[a:b].tobytes(), None) for shard, a, b in bucket.anchor_ranges(layout)]
        return arrow_table(rows, SEGMENT_SCHEMA)
    return emit


def _judge_segments(most_segments: int):
    def judge(table: pa.Table) -> pa.Table:
        # in the buckets' order, so that a range that is judged again names the same senders
        table = table.sort_by("bucket")
        of_anchors = table.column("counts")[0].as_py() is None
        lists = [np.frombuffer(x, dtype=np.uint64).reshape(-1, 4 if of_anchors else 2)
                 for x in table.column("data").to_pylist()]
        joined = np.concatenate(lists)
        _, place = distinct_rows(joined[:, :1] if of_anchors else joined)
        firsts = np.unique(place, return_index=True)[1]
        if of_anchors:
            other = (joined[:, 1:3] != joined[firsts[place], 1:3]).any(axis=1) | (joined[:, 3] > 1)
            different = (np.bincount(place, weights=other) > 0)[place]
            many = (np.bincount(place, weights=joined[:, 3]) > most_segments)[place]
            found = {"sort": different & ~many, "deal": different & many}
        else:
            twice = np.concatenate([bits_of(x, len(k)) for x, k in zip(table.column("counts").to_pylist(), lists, strict=True)])
            sender = np.zeros(len(place), dtype=bool)
            sender[firsts] = True
            found = {"whole": (np.bincount(place, weights=1 + twice) > 1)[place], "sender": sender}
        cuts = np.cumsum([len(x) for x in lists])[:-1]
        return pa.concat_tables([replies(table, kind, np.split(bits, cuts)) for kind, bits in found.items()])
    return judge


def _strings(layout: Layout, length: int, gram: int):
    def emit(table: pa.Table, answers: pa.Table) -> pa.Table:
        bucket = Bucket(table, length, gram)
        rows = []
        sort = bucket.to_send(layout, answers, "sort")
        for shard, a, b in bucket.ranges(layout):
            chosen = a + np.flatnonzero(sort[a:b])
            if len(chosen):
                segments = bucket.example[chosen]
                about = np.column_stack([bucket.distinct[chosen, 0], bucket.runs[segments].astype(np.uint64)])
                rows.append((shard, bucket.number, "sort", b"".join(map(bucket.text, segments)), about.tobytes()))
        dealt_out, _ = distinct_rows(bucket.string_digests(np.flatnonzero(bucket.to_send(layout, answers, "deal")))[0])
        rows += [((1 << layout.shard_bits) + shard, bucket.number, "deal", dealt_out[a:b].tobytes(), None)
                 for shard, a, b in split_ranges(dealt_out[:, 0] >> np.uint64(1), 63 - layout.shard_bits)]
        return arrow_table(rows, STRING_SCHEMA)
    return emit


def repeated_starts(segments: list[bytes], length: int) -> np.ndarray:
    """Of the segments, one after the other, whether the string at each start that has one also starts elsewhere."""
    # separators and the end are smaller than any byte of a text (UTF-8 has none above 0xF4)
    joined = np.frombuffer(b"\xff".join([*segments, b""]), dtype=np.uint8)
    text = np.append(joined + np.uint8(2), np.uint8(0))
    order = suffix_array(text, length)
    previous, common = permuted_lcp(text, order, 4 * length, separator=1)
    long = np.flatnonzero(common >= length)
    repeats = np.zeros(len(text), dtype=bool)
    repeats[long] = True
    repeats[previous[long]] = True
    sizes = np.array([len(s) for s in segments])
    offsets = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    return np.concatenate([repeats[o:o + s - length + 1] for o, s in zip(offsets, sizes, strict=True)])


def _compare(length: int):
    def compare(table: pa.Table) -> pa.Table:
        if table.column("kind")[0].as_py() == "deal":
            lists = [np.frombuffer(x, dtype=np.uint64).reshape(-1, 2) for x in table.column("data").to_pylist()]
            _, place = distinct_rows(np.concatenate(lists))
            shared = np.bincount(place)[place] > 1
            return replies(table, "dealt", np.split(shared, np.cumsum([len(x) for x in lists])[:-1]))
        texts, about = [], []
        for data, notes in zip(table.column("data").to_pylist(), table.column("about").to_pylist(), strict=True):
            notes = np.frombuffer(notes, dtype=np.uint64).reshape(-1, 2)
            ends = np.cumsum(notes[:, 1].astype(np.int64) + length - 1)
            texts += [data[s:e] for s, e in zip([0, *ends[:-1]], ends, strict=True)]
            about.append(notes)
        per_list = [int(x[:, 1].sum()) for x in about]
        notes = np.concatenate(about)
        runs = notes[:, 1].astype(np.int64)
        firsts = np.concatenate([[0], np.cumsum(runs)])
        out = np.zeros(firsts[-1], dtype=bool)
        # anchors are independent: sort a few at a time
        order = np.argsort(notes[:, 0], kind="stable")
        anchor = notes[order, 0]
        start = 0
        while start < len(order):
            end, held = start, 0
            while end < len(order) and (held < SORT_BYTES or anchor[end] == anchor[end - 1]):
                held += len(texts[order[end]]) + 1
                end += 1
            chosen = order[start:end]
            bits = np.split(repeated_starts([texts[k] for k in chosen], length), np.cumsum(runs[chosen])[:-1])
            for k, b in zip(chosen, bits, strict=True):
                out[firsts[k]:firsts[k + 1]] = b
            start = end
        return replies(table, "sorted", np.split(out, np.cumsum(per_list)[:-1]))
    return compare


def _cut(layout: Layout, length: int, gram: int, with_text: bool):
    def emit(table: pa.Table, answers: pa.Table) -> pa.Table:
        bucket = Bucket(table, length, gram)
        # starts of repeated strings, as (block, first, one past the last)
        whole = bucket.answers(layout, answers, "whole")
        chosen = np.flatnonzero(whole[bucket.place])
        found = [(bucket.block[chosen], bucket.starts[chosen], bucket.starts[chosen] + bucket.runs[chosen])]

        def single(segments: np.ndarray, bits: np.ndarray) -> None:
            """Note the strings of ``segments`` whose bit is set."""
            runs = bucket.runs[segments]
            within = np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)
            at = (np.repeat(bucket.starts[segments], runs) + within)[bits]
            found.append((np.repeat(bucket.block[segments], runs)[bits], at, at + 1))

        sort, bits = bucket.to_send(layout, answers, "sort"), by_shard(answers, "sorted")
        for shard, a, b in bucket.ranges(layout):
            segments = bucket.example[a + np.flatnonzero(sort[a:b])]
            if len(segments):
                single(segments, bits_of(bits[shard], int(bucket.runs[segments].sum())))
        deal = np.flatnonzero(bucket.to_send(layout, answers, "deal"))
        strings, _ = bucket.string_digests(deal)
        distinct, place = distinct_rows(strings)
        elsewhere, bits = np.bincount(place, minlength=len(distinct)) > 1, by_shard(answers, "dealt")
        for shard, a, b in split_ranges(distinct[:, 0] >> np.uint64(1), 63 - layout.shard_bits):
            elsewhere[a:b] |= bits_of(bits[(1 << layout.shard_bits) + shard], b - a)
        single(bucket.example[deal], elsewhere[place])
        block, first, past = (np.concatenate(x) for x in zip(*found, strict=True))
        rows = []
        for k, (a, _, joined, ends) in enumerate(bucket.blocks):
            mine = block == k
            steps = np.bincount(first[mine], minlength=len(joined) + 1)
            steps -= np.bincount(past[mine] + length - 1, minlength=len(joined) + 1)
            gone = np.cumsum(steps)[:-1] > 0
            data = np.frombuffer(joined, dtype=np.uint8)
            for j, (s, e) in enumerate(zip([0, *ends[:-1]], ends, strict=True)):
                own = gone[s:e]
                removed = int(own.sum())
                kept = data[s:e][~own].tobytes() if removed else joined[s:e]
                spans = int((np.diff(own.view(np.int8), prepend=np.int8(0)) == 1).sum()) if removed else 0
                row = (bucket.ids[a + j], int(e - s), removed, spans, hashlib.sha256(kept).hexdigest())
                rows.append((*row, kept) if with_text else row)
        return arrow_table(rows, OUT_SCHEMA + ", kept binary" * with_text)
    return emit


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                 gram: int = GRAM, with_text: bool = True, most_segments: int = MOST_SEGMENTS,
                 least_bucket: int = LEAST_BUCKET) -> DataFrame:
    """A row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, the kept bytes."""
    layout = Layout(text_bytes(docs, text_col), least_bucket)
    # The same shuffle of the texts serves all three passes over them.
    buckets = dealt(docs, layout, id_col, text_col).groupBy("bucket")
    judged = (buckets.applyInArrow(_segments(layout, length, gram), SEGMENT_SCHEMA)
              .groupBy("shard").applyInArrow(_judge_segments(most_segments), REPLY_SCHEMA))
    compared = (buckets.cogroup(judged.groupBy("bucket")).applyInArrow(_strings(layout, length, gram), STRING_SCHEMA)
                .groupBy("shard").applyInArrow(_compare(length), REPLY_SCHEMA))
    return buckets.cogroup(judged.unionByName(compared).groupBy("bucket")).applyInArrow(
        _cut(layout, length, gram, with_text), OUT_SCHEMA + ", kept binary" * with_text)
