"""Exact, substring and suffix-array dedup against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from lotlens.llm import exact_dedup, substring_dedup, suffix_dedup
from lotlens.llm.substring_dedup import pack_gaps, unpack_gaps
from lotlens.llm.suffix_array import permuted_lcp, suffix_array

from .conftest import doc_frame, ordered, prose, tuples


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


# exact

def brute_exact(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        kept = False
        for i in ids:
            stays = i == keep and not kept
            kept |= stays
            out.append((i, keep, len(ids), stays, sha(text)))
    return ordered(out)


EXACT = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def test_exact_dedup(awkward_docs, awkward, no_docs):
    assert tuples(exact_dedup.exact_dedup(awkward_docs), *EXACT) == brute_exact(awkward)
    assert exact_dedup.exact_dedup(no_docs).count() == 0


def test_exact_dedup_compares_content(spark, awkward_docs, awkward, monkeypatch):
    """A digest that nearly everything shares changes nothing: contents decide."""
    from pyspark.sql import functions as F
    real = exact_dedup.content_digest
    monkeypatch.setattr(exact_dedup, "content_digest", lambda c: F.substring(real(c), 1, 1))
    got = tuples(exact_dedup.exact_dedup(awkward_docs), *EXACT[:4])
    assert got == ordered(r[:4] for r in brute_exact(awkward))


# substring

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_substring(rows, n=13):
    big = float("inf")
    first = {}
    docs = [(r[0], WORD.findall(r[1] or "")) for r in rows]
    for d, words in docs:
        rank = big if d is None else d
        for i in range(len(words) - n + 1):
            key = tuple(words[i:i + n])
            first[key] = min(first.get(key, big), rank)
    out = []
    for d, words in docs:
        rank = big if d is None else d
        gone = set()
        for i in range(len(words) - n + 1):
            if first[tuple(words[i:i + n])] < rank:
                gone.update(range(i, i + n))
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((d, len(words), len(gone), sha(kept), kept))
    return ordered(out)


SUBSTRING = ("doc_id", "n_words", "n_removed", "kept_sha256", "kept")


@pytest.mark.parametrize("least_bucket", [1 << 20, 3000])
def test_substring_dedup(awkward_docs, awkward, no_docs, least_bucket):
    got = substring_dedup.substring_dedup(awkward_docs, least_bucket=least_bucket)
    assert tuples(got, *SUBSTRING) == brute_substring(awkward)
    assert substring_dedup.substring_dedup(no_docs).count() == 0


def test_substring_windows_follow_each_other(spark):
    """Words kept after a removal may form new repeats: windows are judged on the input."""
    rng = random.Random(5)
    shared = [prose(rng, 20) for _ in range(6)]
    rows = [(k, " ".join(rng.sample(shared, 4) + [prose(rng, 6)])) for k in range(30)]
    got = substring_dedup.substring_dedup(doc_frame(spark, rows), least_bucket=1500)
    assert tuples(got, *SUBSTRING) == brute_substring(rows)


def test_gap_lists():
    rng = np.random.default_rng(1)
    for high in (10, 70_000, 1 << 40):
        values = np.unique(rng.integers(0, high, 500))
        assert (unpack_gaps(pack_gaps(values)) == values).all()
    edge = np.array([0, 65534, 65535, 65536, 131070, 196605, 262141])
    assert (unpack_gaps(pack_gaps(edge)) == edge).all()


# suffix array

def test_suffix_array_and_lcp():
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice("ab" if rng.random() < .5 else "abcdz") for _ in range(rng.randint(1, 70)))
        data = (text[:9] * 12 if rng.random() < .2 else text).encode() + b"\0"
        array = np.frombuffer(data, dtype=np.uint8)
        order = suffix_array(array, len(data))
        expected = sorted(range(len(data)), key=lambda i: data[i:])
        assert order.tolist() == expected
        previous, common = permuted_lcp(array, order, 10 * len(data))
        for before, i in zip(expected, expected[1:]):
            n = 0
            while data[i + n:i + n + 1] == data[before + n:before + n + 1] != b"":
                n += 1
            assert (previous[i], common[i]) == (before, n)


def brute_suffix(rows, length=400):
    texts = [(r[0], (r[1] or "").encode()) for r in rows]
    seen = Counter(t[i:i + length] for _, t in texts for i in range(len(t) - length + 1))
    out = []
    for d, t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(t, gone) if not g)
        out.append((d, len(t), sum(gone), len(re.findall(rb"\x01+", gone)), sha(kept)))
    return ordered(out)


SUFFIX = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@pytest.mark.parametrize("most_segments,least_bucket", [(2048, 1 << 20), (2048, 4000), (1, 4000)])
def test_suffix_dedup(awkward_docs, awkward, no_docs, most_segments, least_bucket):
    """Sorted in ranges, or (anchors with more than one segment) dealt out by string."""
    got = suffix_dedup.suffix_dedup(awkward_docs, most_segments=most_segments, least_bucket=least_bucket)
    assert tuples(got, *SUFFIX) == brute_suffix(awkward)
    assert {(r.doc_id, sha(bytes(r.kept))) for r in got.collect()} == {(r.doc_id, r.kept_sha256) for r in got.collect()}
    assert suffix_dedup.suffix_dedup(no_docs).count() == 0


def test_suffix_dedup_shared_passages(spark):
    rng = random.Random(8)
    shared = [prose(rng, 100) for _ in range(4)]
    rows = []
    for k in range(40):
        cut = rng.choice(shared)
        a = rng.randint(0, 100)
        rows.append((k, prose(rng, 40) + cut[a:a + rng.randint(300, 500)] + prose(rng, 40) + "ab" * rng.randint(0, 400)))
    for most in (2048, 3):
        got = suffix_dedup.suffix_dedup(doc_frame(spark, rows), most_segments=most, least_bucket=5000)
        assert tuples(got, *SUFFIX) == brute_suffix(rows)


def test_suffix_hot_anchor_is_spread():
    """A passage within many different texts leaves no range with much more than its share."""
    rng = random.Random(12)
    passage = prose(rng, 60)[:250]
    rows = [(k, prose(rng, 120)[:300] + passage + prose(rng, 120)[:300]) for k in range(1600)]
    layout = suffix_dedup.Layout(sum(len(t) for _, t in rows), 80_000)
    assert layout.buckets >= 8
    held = Counter()
    for b in range(layout.buckets):
        mine = rows[b::layout.buckets]
        table = pa.table({"doc_id": [d for d, _ in mine], "text": [t for _, t in mine], "bucket": [b] * len(mine)})
        for r in suffix_dedup._segments(layout, 400, 128)(table).to_pylist():
            held[r["shard"]] += len(r["data"])
    assert len(held) >= 8 and max(held.values()) < 2 * sum(held.values()) / len(held), sorted(held.values())
