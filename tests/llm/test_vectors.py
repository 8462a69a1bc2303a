"""Embedding near-dedup, vector codes and importance resampling against brute force."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import types as T

from lotlens.llm import prefix_crc, resample, vector_codes, vector_join
from lotlens.llm.components import components, spread_join

from .conftest import DOC_SCHEMA, awkward_rows, doc_frame, ordered, prose, tuples

VECTOR_SCHEMA = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("label", T.IntegerType()),
    # names that operators use for columns of their own
    *[T.StructField(c, T.StringType()) for c in ("ball", "digest", "code", "error", "n", "grp", "vector", "members")]])


def vector_frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], label, *["x"] * 8)
                                  for i, v, label in rows], VECTOR_SCHEMA).repartition(3)


def usable(v):
    return v is not None and len(v) > 0 and all(c is not None and math.isfinite(c) for c in v)


def single(v):
    return np.array(v, dtype=np.float32).astype(np.float64)


def brute_links(rows, similarity=0.93):
    """(vec_id, n_links, component_id, kept) of every row."""
    able = [k for k, (_, v, label) in enumerate(rows) if usable(v) and label is not None and np.any(single(v))]
    links = {k: set() for k in range(len(rows))}
    for a in able:
        for b in able:
            if a < b and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = single(rows[a][1]), single(rows[b][1])
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= similarity:
                    links[a].add(b)
                    links[b].add(a)
    out, seen = [], {}
    for k in range(len(rows)):
        if k not in seen:
            todo, group = [k], set()
            while todo:
                at = todo.pop()
                if at not in group:
                    group.add(at)
                    todo += links[at]
            low = min((rows[g][0] for g in group if rows[g][0] is not None), default=None)
            seen |= dict.fromkeys(group, low)
        out.append((rows[k][0], len(links[k]), seen[k], rows[k][0] == seen[k]))
    return ordered(out)


def around(rng, centre, spread, n):
    return [centre + spread * rng.standard_normal(len(centre)) / math.sqrt(len(centre)) for _ in range(n)]


def vector_rows(seed=4):
    """Tight, loose and chained near-copy groups, copies, stray vectors and awkward ones, of two labels."""
    rng = np.random.default_rng(seed)
    found = []
    for label in (1, 2):
        for spread, n in ((0.02, 60), (0.12, 40), (0.25, 40), (0.33, 40), (0.6, 30)):
            centre = rng.standard_normal(24)
            found += [(v, label) for v in around(rng, centre / np.linalg.norm(centre), spread, n)]
        angles = np.arange(12) * 0.3  # a chain: neighbours are linked, the next but one is not
        found += [(np.concatenate([[math.cos(t), math.sin(t)], np.zeros(22)]), label) for t in angles]
        found += [(rng.standard_normal(24), label) for _ in range(60)]
    rows = [(int(i), [float(c) for c in v], label) for i, (v, label) in zip(rng.permutation(len(found)), found, strict=True)]
    copy = rows[5][1]
    rows += [(1000 + k, copy, rows[5][2]) for k in range(30)] + [(1100, copy, 3), (1101, [2 * c for c in copy], 3)]
    rows += [(2000, None, 1), (2001, [], 1), (2002, [0.0] * 24, 1), (2003, [float("nan")] + [1.0] * 23, 1),
             (2004, [float("inf")] + [1.0] * 23, 1), (2005, [None] + [1.0] * 23, 1), (2006, copy, None), (2007, [-0.0] + [1.0] * 23, 1),
             (2008, [0.0] + [1.0] * 23, 1), (2009, [1.0] * 16, 1), (2010, [1.0] * 16, 1), (None, copy, 3), (None, [5.0] * 24, 7),
             (2011, [1e-30] * 24, 4), (2012, [1e30] * 24, 4), (7, copy, 3), (7, copy, 3), (2013, [3.0], 4), (2014, [-3.0], 4)]
    return rows


LINKS = ("vec_id", "n_links", "component_id", "kept")


@pytest.mark.parametrize("cell", [vector_join.CELL, 50])
def test_near_vectors(spark, cell):
    rows = vector_rows()
    assert tuples(vector_join.near_vectors(vector_frame(spark, rows), cell=cell), *LINKS) == brute_links(rows)


def test_near_vectors_other_similarity_and_empty_table(spark):
    rows = vector_rows(9)
    got = vector_join.near_vectors(vector_frame(spark, rows), similarity=0.8)
    assert tuples(got, *LINKS) == brute_links(rows, 0.8)
    assert vector_join.near_vectors(spark.createDataFrame([], VECTOR_SCHEMA)).count() == 0


def test_rotation_keeps_distances():
    rng = np.random.default_rng(2)
    for n in (1, 5, 24, 64, 100):
        x = rng.standard_normal((20, n))
        y = vector_join.rotated(x)
        assert np.allclose(x @ x.T, y @ y.T)


def test_a_near_copy_group_becomes_few_balls(spark):
    """A hot group is merged before anything is compared: balls do not grow with its vectors."""
    rng = np.random.default_rng(3)
    for n in (600, 1200, 2400):
        centre = rng.standard_normal(32)
        x = vector_join.rotated(vector_join.unit(np.stack(around(rng, centre / np.linalg.norm(centre), 0.05, n))))
        signs = (x[:, :32] > 0) @ (1 << np.arange(61, 29, -1))
        order = np.argsort(signs)
        balls = list(vector_join.balls_of(x[order], signs[order], math.sqrt(0.14) / 4))
        assert sum(len(m) for m, _, _ in balls) == n
        assert len(balls) == 1


def test_components_and_spread_join(spark, monkeypatch):
    from lotlens.llm import components as module
    monkeypatch.setattr(module, "LEAST", 20)
    monkeypatch.setattr(module, "SHARE", 4)
    rng = random.Random(1)
    edges = [(0, k) for k in range(1, 60)] + [(100 + k, 101 + k) for k in range(40)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)]
    links = {}
    for a, b in edges:
        if a != b:
            links.setdefault(a, set()).add(b)
            links.setdefault(b, set()).add(a)
    want = {}
    for k in sorted(links):
        todo = [] if k in want else [k]
        while todo:
            at = todo.pop()
            if at not in want:
                want[at] = k
                todo += links[at]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want
    hot = spark.createDataFrame([(k % 3 and 1, k) for k in range(300)], "k long, v long")
    table = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "id long, name string")
    joined = spread_join(hot, "k", table, "id")
    assert tuples(joined, "v", "name") == sorted((k, "b" if k % 3 else "a") for k in range(300))


# vector codes

def brute_codes(rows, entries=16, rounds=6, parts=8):
    able = [(i, [math.floor(4096 * c) for c in single(v)], label) for i, v, label in rows if v is not None and (len(v) == 0 or usable(v))]
    order = sorted(able, key=lambda r: (r[0] is None, r[0] or 0, len(r[1]), [c & 0xff for c in r[1]]))
    n = next((len(r[1]) for r in order if len(r[1]) and len(r[1]) % parts == 0), None)
    if n is None:
        return ordered((i, None, None, None) for i, _, _ in able)
    whole = [r for r in able if len(r[1]) == n]
    x = np.array([r[1] for r in whole], dtype=np.int64).reshape(len(whole), parts, -1)
    first = sorted(range(len(whole)), key=lambda k: (whole[k][0] is None, whole[k][0] or 0))[:entries]
    books = x[first].transpose(1, 0, 2).copy()

    def assigned():
        d = ((x[:, :, None, :] - books[None]) ** 2).sum(axis=3)
        return d.argmin(axis=2), d.min(axis=2).sum(axis=1)

    for _ in range(rounds):
        best, _ = assigned()
        for p in range(parts):
            for e in range(books.shape[1]):
                if (best[:, p] == e).any():
                    books[p, e] = x[best[:, p] == e, p].sum(axis=0) // (best[:, p] == e).sum()
    best, error = assigned()
    by_label = {}
    for (_, _, label), e in zip(whole, error, strict=True):
        by_label[label] = by_label.get(label, 0) + int(e)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    codes = {id(r): ("".join(f"{c:02x}" for c in b), int(e)) for r, b, e in zip(whole, best.tolist(), error, strict=True)}
    return ordered((r[0], *codes.get(id(r), (None, None)), by_label.get(r[2]), digest) for r in able)


CODES = ("vec_id", "code", "error", "label_error", "codebooks_sha256")


def code_rows(n=300, width=16, seed=6):
    rng = np.random.default_rng(seed)
    rows = [(int(i), [float(c) for c in rng.standard_normal(width) / 4], int(rng.integers(0, 3)) if k % 7 else None)
            for k, i in enumerate(rng.permutation(n))]
    rows += [(1000 + k, rows[3][1], 1) for k in range(40)]
    return [*rows, (2000, None, 1), (2001, [float("nan")] * width, 1), (2002, [float("-inf")] + [0.0] * (width - 1), 2),
            (2003, [None] + [0.0] * (width - 1), 0), (2004, [0.0] * width, None), (2005, [0.5] * (width + 1), 1), (2006, [], 1),
            (2007, [0.1] * (2 * width), 8), (None, rows[8][1], 2), (2008, rows[9][1], 2), (2008, rows[9][1], 2), (-5, [30000.0] * width, 2)]


@pytest.mark.parametrize("entries", [16, 3, 100])
def test_vector_codes(spark, entries):
    rows = code_rows()
    got = vector_codes.vector_codes(vector_frame(spark, rows), entries=entries)
    assert tuples(got, *CODES) == brute_codes(rows, entries)


def test_vector_codes_of_few_vectors(spark):
    assert vector_codes.vector_codes(spark.createDataFrame([], VECTOR_SCHEMA)).count() == 0
    rows = [(3, [1.0, 2.0] * 8, 1), (4, [1.0, 2.0] * 8, 1), (5, [0.0] * 16, None)]
    assert tuples(vector_codes.vector_codes(vector_frame(spark, rows)), *CODES) == brute_codes(rows)
    odd = vector_codes.vector_codes(vector_frame(spark, [(1, [1.0] * 3, 1), (2, [], 1)]))
    assert tuples(odd, "vec_id", "code", "error", "label_error") == [(1, None, None, None), (2, None, None, None)]


def test_a_component_that_cannot_be_coded_is_an_error(spark):
    with pytest.raises(Exception, match="a component is beyond"):
        vector_codes.vector_codes(vector_frame(spark, [(1, [1e9] * 8, 1)]))


@pytest.mark.parametrize("entries", [1, 2, 16, 64, 65, 130])
def test_nearest_entry(entries):
    """Ties, repeated entries, vectors far outside and radii that have to grow."""
    rng = np.random.default_rng(entries)
    book = rng.integers(-6, 7, (entries, 4))
    book[entries // 2] = book[0]
    x = np.concatenate([rng.integers(-8, 9, (500, 4)), rng.integers(-100_000, 100_000, (50, 4))])
    best, error = vector_codes.Slices(book).nearest(x)
    d = ((x[:, None] - book[None]) ** 2).sum(axis=2)
    assert (best == d.argmin(axis=1)).all()
    assert (error == d.min(axis=1)).all()


def test_codes_stand_for_vectors(spark):
    rng = np.random.default_rng(8)
    rows = [(k, [float(c) for c in rng.standard_normal(8) / 4], 1) for k in range(16)]
    packed = vector_codes.integer_vectors(vector_frame(spark, rows))
    books = vector_codes.first_books(packed, 8)
    for r in vector_codes.vector_codes(vector_frame(spark, rows), rounds=0).collect():
        assert np.abs(vector_codes.decoded(r.code, books) - single(rows[r.vec_id][1])).max() <= 1 / 4096


# importance resampling

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def features(text, buckets=10_000):
    words = WORD.findall((text or "").encode().translate(LOWER))
    return len(words), [zlib.crc32(b" ".join(words[i:i + n])) % buckets for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def brute_resample(rows, target, percent=5):
    docs = [(r[0], *features(r[1])) for r in rows]
    s, t = [0] * 10_000, [0] * 10_000
    for _, _, found in docs:
        for f in found:
            s[f] += 1
    for text in target:
        for f in features(text)[1]:
            t[f] += 1
    total_s, total_t = float(sum(s)), float(sum(t))
    gains = [math.floor(1000 * math.log((float(b) + 1) * (total_s + 10_000) / ((float(a) + 1) * (total_t + 10_000)))) for a, b in zip(s, t, strict=True)]
    out = []
    for i, words, found in docs:
        weight = sum(gains[f] for f in found)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, words])
    able = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for k, r in enumerate(able[:percent * len(able) // 100]):
        r[4] = k + 1
    return ordered(tuple(r[:5]) for r in out)


RESAMPLE = ("doc_id", "n_features", "weight", "score", "rank")


@pytest.mark.parametrize("percent", [5, 60, 100])
def test_importance_resample(spark, percent):
    rng = random.Random(4)
    rows = [*awkward_rows(), (400, "w" * 5000 + " " + "é" * 700 + " end, of. it\x00now"), (401, None)]
    target = [prose(rng, 300), None, "", rows[0][1][:400], "One TWO three"]
    docs, items = doc_frame(spark, rows), doc_frame(spark, list(enumerate(target)))
    assert tuples(resample.importance_resample(docs, items, percent=percent), *RESAMPLE) == brute_resample(rows, target, percent)


def test_resampled_documents(spark):
    """The drawn documents themselves; a repeated row is drawn as often as its copies were."""
    rng = random.Random(4)
    rows = [*awkward_rows(), *[(500, "the same row again and again " * 5)] * 6]
    target = [prose(rng, 200), rows[0][1]]
    docs, items = doc_frame(spark, rows), doc_frame(spark, list(enumerate(target)))
    ranks = resample.importance_resample(docs, items, percent=50)
    got = resample.resampled(docs, items, percent=50)
    assert got.columns == docs.columns
    assert tuples(got, "doc_id") == ordered((r.doc_id,) for r in ranks.filter("rank is not null").collect())
    assert {(r.doc_id, r.text) for r in got.collect()} <= {(r[0], r[1]) for r in rows}


def test_importance_resample_of_nothing(spark, no_docs, awkward_docs, awkward):
    assert resample.importance_resample(no_docs, awkward_docs).count() == 0
    assert tuples(resample.importance_resample(awkward_docs, no_docs), *RESAMPLE) == brute_resample(awkward, [])
    assert no_docs.schema == DOC_SCHEMA


def test_crc_of_any_piece():
    rng = random.Random(3)
    data = bytes(rng.randrange(256) for _ in range(3000)) + bytes(2000)
    registers = prefix_crc.running_registers(data)
    starts = np.array([rng.randrange(5000) for _ in range(2000)])
    ends = np.array([rng.randrange(a, 5001) for a in starts])
    want = [zlib.crc32(data[a:b]) for a, b in zip(starts, ends, strict=True)]
    assert prefix_crc.piece_crcs(registers, starts, ends).tolist() == want
    assert len(prefix_crc.running_registers(b"")) == 1
