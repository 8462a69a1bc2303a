"""Jaccard join, WARC archives, mixing, sharding and the pipeline."""

import base64
import gzip
import hashlib
import math
import os
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lotlens.llm import jaccard_join, mixing, sharding, warc
from lotlens.session import scratch_path

from .conftest import doc_frame, ordered, prose, tuples
from .test_text import brute_hits

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORD.findall(text or "")
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_near(rows, least=0.8):
    """doc_id, class_id, copy_id, n_copies, n_links per row."""
    ids = defaultdict(list)
    for r in rows:
        ids[r[1] or ""].append(r[0])
    texts = list(ids)
    sets = {t: shingles(t) for t in texts}
    links = defaultdict(set)
    for i, a in enumerate(texts):
        for b in texts[i + 1:]:
            x, y = sets[a], sets[b]
            if x and y and len(x & y) >= (least - 1e-12) * len(x | y):
                links[a].add(b)
                links[b].add(a)
    smallest = {t: min((i for i in v if i is not None), default=None) for t, v in ids.items()}
    group = {}
    for t in texts:
        if t not in group:
            found, todo = {t}, [t]
            while todo:
                new = links[todo.pop()] - found
                found |= new
                todo += new
            first = min((smallest[x] for x in found if smallest[x] is not None), default=None)
            group |= dict.fromkeys(found, first)
    return ordered((i, group[t], smallest[t], len(v), len(links[t])) for t, v in ids.items() for i in v)


NEAR = ("doc_id", "class_id", "copy_id", "n_copies", "n_links")


def near_copies(rng, text, n, edits):
    words = text.split()
    out = []
    for _ in range(n):
        w = list(words)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = str(rng.random())
        out.append(" ".join(w))
    return out


def test_jaccard_join_awkward(awkward_docs, awkward, no_docs):
    assert tuples(jaccard_join.near_duplicates(awkward_docs), *NEAR) == brute_near(awkward)
    assert jaccard_join.near_duplicates(no_docs).count() == 0


@pytest.mark.parametrize("small,depth", [(64, 6), (4, 3)])
def test_jaccard_join_finds_all(spark, small, depth):
    """Near copies around the threshold, with boilerplate; small buckets force splits and blocks."""
    rng = random.Random(21)
    boiler = prose(rng, 60)
    texts = []
    for _ in range(12):
        texts += near_copies(rng, prose(rng, 150), 8, 4)
    texts += near_copies(rng, prose(rng, 200), 30, 1)
    texts += [boiler + " " + prose(rng, 15) for _ in range(30)] + [prose(rng, 80) for _ in range(40)]
    texts += texts[:10] * 3
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    got = jaccard_join.near_duplicates(doc_frame(spark, rows), small=small, depth=depth)
    assert tuples(got, *NEAR) == brute_near(rows)


@pytest.mark.parametrize("edits,n", [(1, 300), (6, 200), (15, 200)])
def test_linked_pairs_against_all(edits, n):
    """Pivots decide what the triangle inequality allows, and nothing else."""
    rng = random.Random(edits)
    texts = near_copies(rng, prose(rng, 120), n, edits) + near_copies(rng, prose(rng, 60), 40, 3) + [prose(rng, 30) for _ in range(20)]
    sets = [np.unique(np.array([hash(x) for x in shingles(t)], dtype=np.int64)) for t in texts]
    pairs = np.array([(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if rng.random() < 0.7])
    want = [(i, j) for i, j in pairs.tolist()
            if (c := len(np.intersect1d(sets[i], sets[j]))) >= 0.8 * (len(sets[i]) + len(sets[j]) - c) - 1e-9]
    for some in (pairs, pairs[:50]):
        got, asked = jaccard_join.linked_pairs(sets, some, 0.8), set(map(tuple, some.tolist()))
        assert sorted(map(tuple, got.tolist())) == sorted(p for p in want if p in asked)


def held_rows(spark, rows, small):
    docs = doc_frame(spark, rows)
    _, classes = jaccard_join.text_classes(docs)
    balls_of = lambda hot: jaccard_join.near_copy_balls(
        hot, lambda wanted: jaccard_join.shingle_rows(docs, classes, wanted, "doc_id", "text", 5), 0.8, small)
    members, _, balls = jaccard_join.chosen_path_buckets(classes, 3, small=small, balls_of=balls_of)
    return members.count() / classes.count(), balls.count() / classes.count()


def test_rows_of_a_tight_group_are_linear(spark):
    """A group of near copies far beyond a bucket: what buckets hold grows with the group, not with its pairs."""
    rng = random.Random(2)
    text, held = prose(rng, 150), {}
    for n in (300, 600, 1200):
        held[n], inside = held_rows(spark, list(enumerate(near_copies(rng, text, n, 1))), 64)
        assert inside > 0.9
    assert held[1200] < 1.25 * held[300]


def test_balls_lose_and_add_nothing(spark):
    """Groups of several widths, some around a pivot and some not, one inside another's boilerplate; small buckets."""
    rng = random.Random(12)
    base, other = prose(rng, 120), prose(rng, 120)
    texts = near_copies(rng, base, 90, 1) + near_copies(rng, base, 60, 5) + near_copies(rng, base, 40, 12)
    texts += near_copies(rng, other, 80, 2) + [base + " " + prose(rng, 40) for _ in range(20)] + [prose(rng, 50) for _ in range(30)]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    got = jaccard_join.near_duplicates(doc_frame(spark, rows), small=16, depth=4)
    assert tuples(got, *NEAR) == brute_near(rows)


def test_plans_of_the_join_stay_small(spark, monkeypatch):
    """What is planned at once does not repeat the levels before it: the driver holds every node of a plan."""
    rng, scans, written = random.Random(3), {}, jaccard_join.materialised

    def counted(df, name):
        scans[name] = max(scans.get(name, 0), df._jdf.queryExecution().optimizedPlan().toString().count("Relation ["))
        return written(df, name)

    monkeypatch.setattr(jaccard_join, "materialised", counted)
    boiler = prose(rng, 60)
    texts = near_copies(rng, prose(rng, 150), 40, 8) + [boiler + " " + prose(rng, 15) for _ in range(60)]
    jaccard_join.near_duplicate_classes(doc_frame(spark, list(enumerate(texts))), small=4, depth=4)
    assert len([name for name in scans if name.startswith("paths-")]) >= 3
    assert max(scans.values()) <= 20, scans


def test_one_of_each(awkward_docs, awkward, no_docs):
    kept = jaccard_join.one_of_each(awkward_docs)
    assert kept.columns == awkward_docs.columns
    groups = defaultdict(list)
    for r, text in zip(brute_near([(k, r[1]) for k, r in enumerate(awkward)]), awkward):
        groups[r[1]].append(text[0])
    expected = ordered((min((i for i in v if i is not None), default=None),) for v in groups.values())
    assert ordered((r.doc_id,) for r in kept.collect()) == expected
    assert jaccard_join.one_of_each(no_docs).count() == 0


def test_runs_reach_the_target():
    assert jaccard_join.runs_for(0.999) == 3 and jaccard_join.runs_for(0.9) == 1


# archives

def page_frame(spark, rows):
    return spark.createDataFrame([(p, u, h, "x") for p, u, h in rows],
                                 "page_id bigint, url string, html string, record_type string").repartition(2)


def brute_pages(rows):
    def known(p):
        return (p is not None, p)
    original = {}
    for p, _, h in rows:
        original[h or ""] = max(original.get(h or "", p), p, key=known)
    out, used = [], set()
    for p, _, h in rows:
        data = (h or "").encode()
        first = p == original[h or ""] and h not in used
        if first:
            used.add(h)
        out.append((p, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(),
                    "response" if first else "revisit", None if first else original[h or ""]))
    return ordered(out)


PAGES = [(1, "http://a/", "<p>é</p>"), (2, "http://b/", "<p>é</p>"), (7, None, "<p>é</p>"), (3, "http://c/%41 b\r\nX: y", ""),
         (4, "u", None), (5, "u", "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n\r\n\r\n"), (6, "u", "\r\n\r\n"),
         (8, "u", "long " * 60_000), (9, "u", "long " * 60_000), (None, "u", "<p>é</p>"), (None, "u", "alone"),
         (10, "u", "twin"), (10, "u", "twin")]


def test_archive_pages(spark):
    got = warc.archive_pages(spark, page_frame(spark, PAGES))
    assert tuples(got, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == \
        brute_pages([(p, u, h or "") for p, u, h in PAGES])
    assert warc.archive_pages(spark, page_frame(spark, PAGES).limit(0)).count() == 0


def test_archives_round_trip(spark):
    path, deduplicated = scratch_path(spark, "warc-test"), scratch_path(spark, "warc-test")
    warc.write_archives(warc.page_records(page_frame(spark, PAGES)), path, per_archive=3)
    back = warc.read_archives(spark, path, payloads=True)
    assert tuples(back, "page_id", "url", "payload") == ordered((p, u, h or "") for p, u, h in PAGES)
    warc.deduplicate(spark, path, deduplicated, min_bytes=6)
    kinds = warc.read_archives(spark, deduplicated, payloads=True)
    assert kinds.filter("record_type = 'revisit'").count() == 4  # three of the four short pages, one long; none under six bytes
    assert kinds.filter("record_type = 'revisit' and (payload is not null or refers_to_record is null)").count() == 0
    assert kinds.select("record_id").distinct().count() == len(PAGES)
    local = deduplicated.removeprefix("file:")
    data = b"".join(gzip.open(os.path.join(local, f)).read() for f in os.listdir(local) if f.endswith(".gz"))
    assert data.count(b"WARC-Profile: " + warc.PROFILE.encode()) == 4


def test_archives_are_bounded_in_bytes(spark):
    """Small records come together by number, large ones by bytes; a page beyond an archive is one of its own."""
    rng = random.Random(6)
    pages = [(k, "u", "x" * (rng.choice((10, 300, 2500, 9000)) + k)) for k in range(120)] + [(500, "u", "y" * 100_000), (501, "u", None)]
    path = scratch_path(spark, "warc-test")
    warc.write_archives(warc.page_records(page_frame(spark, pages).coalesce(1)), path, per_archive=64, archive_bytes=1 << 15)
    local, held = path.removeprefix("file:"), []
    for f in os.listdir(local):
        if f.endswith(".gz"):
            data = gzip.open(os.path.join(local, f)).read()
            held.append((data.count(b"WARC-Record-ID"), data.count(b"x") + data.count(b"y")))
    assert sum(n for n, _ in held) == len(pages) and max(n for n, _ in held) > 30
    assert all(size <= 1 << 15 for n, size in held if n > 1) and max(held, key=lambda h: h[1])[0] == 1
    assert tuples(warc.read_archives(spark, path, payloads=True), "page_id", "payload") == ordered((p, h or "") for p, _, h in pages)
    assert [n for n, _ in warc.size_classes()] == [10_000, 1250, 156, 19, 2, 1]


def test_archives_are_read_record_by_record():
    """An archive of 200 MB of pages needs the memory of one record."""
    body = b"HTTP/1.1 200 OK\r\n\r\n" + b"z" * (10 << 20)
    digest = base64.b32encode(hashlib.sha1(b"z" * (10 << 20)).digest())
    record = (b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:1>\r\nWARC-Payload-Digest: sha1:" + digest
              + b"\r\nX-Payload-SHA256: 0\r\nContent-Length: %d\r\n\r\n" % len(body) + body + b"\r\n\r\n")
    packer = zlib.compressobj(1, wbits=31)
    packed = b"".join([*(packer.compress(record) for _ in range(20)), packer.flush()])
    tracemalloc.start()
    try:
        sizes = [row[4] for row in warc._records(pa.py_buffer(packed), True)]
        _, peak = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    assert sizes == [10 << 20] * 20 and peak < 80 << 20


# mixing

def brute_targets(sizes, cap=3):
    """Hand out by weight until no source is above its cap."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: 1 + k % 3 for k, s in enumerate(names)}
    full = set()
    while True:
        left = sum(sizes.values()) - sum(cap * sizes[s] for s in full)
        free = sum(weight[s] for s in names if s not in full)
        target = {s: cap * sizes[s] if s in full else left * weight[s] / free for s in names}
        above = {s for s in names if s not in full and target[s] > cap * sizes[s]}
        if not above:
            return target
        full |= above


def brute_mix(rows):
    size = {k: len(WORD.findall(r[1] or "")) for k, r in enumerate(rows)}
    sizes = Counter()
    for k, r in enumerate(rows):
        sizes[r[2] if len(r) > 2 else "s"] += size[k]
    target = brute_targets(sizes)
    out = []
    for k, r in enumerate(rows):
        s = r[2] if len(r) > 2 else "s"
        rate = target[s] / sizes[s] if sizes[s] else 0.0
        u = int(hashlib.md5(f"{'' if r[0] is None else r[0]}:mix".encode()).hexdigest()[:13], 16) / 2 ** 52
        copies = math.floor(rate) + (u < rate - math.floor(rate))
        out.append((r[0], size[k], sizes[s], round(float(target[s]), 6), size[k] * copies))
    return ordered(out)


MIX = ("doc_id", "size", "source_size", "target", "taken")


def test_mixing(spark, awkward_docs, awkward, no_docs):
    got = mixing.mix_report(awkward_docs).withColumn("target", F.round("target", 6))
    assert tuples(got, *MIX) == brute_mix(awkward)
    mixed = mixing.mix(awkward_docs)
    assert mixed.columns == awkward_docs.columns
    taken = Counter(r.doc_id for r in mixed.collect())
    copies = Counter()
    for d, size, _, _, words in brute_mix(awkward):
        copies[d] += words // size if size else 0
    assert {d: n for d, n in taken.items() if copies[d]} == {d: n for d, n in copies.items() if n}
    assert mixing.mix_report(no_docs).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_targets_fill_up(spark, seed):
    rng = random.Random(seed)
    sizes = {rng.choice(["é", "a", "Z", "zz", "ab", "~"]) + str(k): rng.choice([0, 1, 5, 100, 10_000]) + k for k in range(rng.randint(1, 9))}
    sizes[None] = 7
    rates = mixing.source_rates(spark.createDataFrame(list(sizes.items()), "source string, size bigint"))
    got = {r.source: r.target for r in rates.collect()}
    expected = brute_targets(sizes)
    assert got.keys() == expected.keys() and all(math.isclose(got[s], expected[s], rel_tol=1e-9) for s in got)
    assert math.isclose(sum(got.values()), sum(sizes.values()), rel_tol=1e-9)


@pytest.mark.parametrize("sizes", [
    {"a": 100, "b": 200}, {"a": 100, "b": 500, "c": 900, "d": 100}, {"a": 100, "b": 200, "c": 300},
    {"a": 1, "b": 100, "c": 5000, "d": 50, "e": 100, None: 150}])
def test_targets_of_tied_sources(spark, sizes):
    """Sources that reach their cap at the same level share what is left, in whatever order they come."""
    expected = brute_targets(sizes)
    for rows in (list(sizes.items()), list(sizes.items())[::-1]):
        rates = mixing.source_rates(spark.createDataFrame(rows, "source string, size bigint"))
        got = {r.source: r.target for r in rates.collect()}
        assert got.keys() == expected.keys() and all(math.isclose(got[s], expected[s], rel_tol=1e-9) for s in got)
        assert math.isclose(sum(got.values()), sum(sizes.values()), rel_tol=1e-9)


# sharding

def test_sharding(spark, awkward_docs, awkward, no_docs):
    got = sharding.shard_rows(awkward_docs).collect()
    assert ordered((r.doc_id, r.size, r.text_crc32) for r in got) == ordered(
        (d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t, *_ in awkward)
    by_shard = defaultdict(list)
    for r in got:
        assert r.law == "key" and 0 <= r.shard < 40 and r.grown_shard in (r.shard, 40)
        by_shard[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by_shard.values())
    assert len({(r.doc_id, r.shard) for r in got}) == len({r.doc_id for r in got})
    assert sharding.shard_rows(no_docs).count() == 0


def python_walk(seed, shards):
    """Jump consistent hashing over the same random bits."""
    mask = 2 ** 64 - 1
    x, at, shard = seed & mask or 1, 0, 0
    while True:
        x ^= x << 13 & mask
        x ^= x >> 7
        x ^= x << 17 & mask
        at = int((at + 1) * 2.0 ** 31 / float((x >> 33) + 1))
        if at >= shards:
            return shard
        shard = at


def test_jump_hashing(spark):
    keys = spark.range(20_000).select("id", F.xxhash64("id").alias("seed"))
    walks = {n: keys.withColumn("w", sharding.jump_shards(F.col("id"), n)).select("id", "seed", "w.*").collect() for n in (1, 2, 40, 41)}
    for n, rows in walks.items():
        assert all(r.shard == python_walk(r.seed, n) and r.grown == python_walk(r.seed, n + 1) for r in rows[:3000])
        counts = Counter(r.shard for r in rows)
        assert len(counts) == n and max(counts.values()) < 1.3 * len(rows) / n
    assert {r.id: r.grown for r in walks[40]} == {r.id: r.shard for r in walks[41]}
    moved = sum(r.shard != r.grown for r in walks[40])
    assert all(r.grown == 40 for r in walks[40] if r.shard != r.grown) and abs(moved - 20_000 / 41) < 120


# pipeline

def test_pipeline_stages(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "decontamination", "mixing", "sharding"]
    stage = dict(corpus_pipeline.STAGES)
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]

    good = stage["quality"](spark, docs, sf_dir).cache()
    assert good.columns == docs.columns
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    kept = {r.doc_id for r in good.collect()}
    right = [(d in kept) == bool(q) for d, q in labels.items()]
    assert sum(right) >= 0.95 * len(right)

    rows = [r for r in rows if r[0] in kept]
    single = stage["near_duplicates"](spark, good, sf_dir).cache()
    firsts = {r[1] for r in brute_near(rows)}
    assert sorted(r.doc_id for r in single.collect()) == sorted(firsts)

    rows = [r for r in rows if r[0] in firsts]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    bad = {r[0] for r in brute_hits(rows, items) if r[4]}
    clean = stage["decontamination"](spark, single, sf_dir).cache()
    rows = [r for r in rows if r[0] not in bad]
    assert clean.columns == docs.columns and sorted(r.doc_id for r in clean.collect()) == sorted(r[0] for r in rows)

    copies = {r[0]: r[4] // r[1] for r in brute_mix(rows) if r[4]}
    mixed = stage["mixing"](spark, clean, sf_dir).cache()
    assert mixed.columns == docs.columns and Counter(r.doc_id for r in mixed.collect()) == copies

    sharded = stage["sharding"](spark, mixed, sf_dir).collect()
    assert Counter(r.doc_id for r in sharded) == copies
    slots = defaultdict(list)
    for r in sharded:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_decontamination_stage_judges_each_row(spark, tmp_path):
    """A contaminated document takes no clean one with it that has its id, or none as well."""
    item = prose(random.Random(1), 30)
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    bad = [(1, "see " + item, "a"), (None, item + " end", "b"), (2, item, "a"), (2, item, "a")]
    good = [(1, "clean with a shared id", "a"), (None, "clean without an id", "b"), (None, None, "a"), (None, "", None),
            (2, "another text", "a"), (3, "its own id", "c"), (3, "its own id", "c")]
    docs = doc_frame(spark, bad + good)
    clean = corpus_pipeline.decontamination_stage(spark, docs, str(tmp_path))
    assert clean.columns == docs.columns
    assert tuples(clean, "doc_id", "text", "source") == ordered(good)


def test_mixing_stage_draws_rows_of_one_id_apart(spark):
    """Rows without id, or with the same, meet the target together; rows with their own id draw by it alone."""
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(10)) + f" {k}" for k in range(1200)]
    rows = [(None, t, "a") for t in texts[:400]] + [(7, t, "b") for t in texts[400:800]]
    own = [(1000 + k, t, "c") for k, t in enumerate(texts[800:])]
    docs = doc_frame(spark, rows + own)
    mixed = corpus_pipeline.mixing_stage(spark, docs, "")
    assert mixed.columns == docs.columns
    taken = Counter((r.doc_id, r.text, r.source) for r in mixed.collect())
    target = brute_targets({s: 400 * 11 for s in "abc"})
    for s in "ab":
        words = sum(11 * n for (_, _, source), n in taken.items() if source == s)
        assert abs(words - target[s]) < 0.1 * 400 * 11
    alone = {r[0]: r[4] // r[1] for r in brute_mix(rows + own) if r[4] and r[0] is not None and r[0] >= 1000}
    assert {d: n for (d, _, source), n in taken.items() if source == "c"} == alone
    again = corpus_pipeline.mixing_stage(spark, docs.repartition(5), "")
    assert Counter((r.doc_id, r.text, r.source) for r in again.collect()) == taken
    without_id = corpus_pipeline.mixing_stage(spark, docs.filter("doc_id is null"), "")
    assert without_id.columns == docs.columns and without_id.count() == 400
