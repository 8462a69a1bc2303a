"""PII, quality rules and benchmark decontamination."""

import hashlib
import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lotlens.llm import decontam, pii, quality

from .conftest import doc_frame, ordered, prose, tuples

BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(digits):
    doubled = [int(d) * (1 + k % 2) for k, d in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def brute_pii(text):
    out = []
    for kind, pattern in BASE.items():
        for m in pattern.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            fine = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                    "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if fine:
                out.append((kind, m.start(), m.end()))
    return out


def test_pii_base_spans_are_those_of_the_patterns():
    rng = random.Random(1)
    for _ in range(20_000):
        text = "".join(rng.choice("ab@@..--+ 1112 3()é%4_") for _ in range(rng.randint(0, 40)))
        got = [tuple(s[:3]) for s in pii.find_spans(text) if s.kind in pii.BASE_KINDS]
        assert got == brute_pii(text), text


def test_pii_validators_and_context():
    text = "card 4111 1111 1111 1111, not 4111 1111 1111 1112; iban GB82 WEST 1234 5698 7654 32, DE89370400440532013001"
    spans = pii.find_spans(text)
    assert [s.kind for s in spans] == ["card", "iban"]
    assert text[spans[1].start:spans[1].end] == "GB82 WEST 1234 5698 7654 32"
    assert pii.score("my card 4111111111111111", "card", 8, 24) > pii.score("isbn 4111111111111111", "card", 5, 21)
    assert pii.find_spans("serial GB82WEST12345698765432") == []  # an added span that its context speaks against
    assert len(pii.find_spans("isbn 4111111111111111")) == 1  # a base span stays
    assert pii._redact("write to a.b@c.de now") == "write to [EMAIL] now"


def test_pii_long_runs_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "+1" * 150_000, "a@" * 100_000, "1 " * 150_000, "A1" * 150_000):
        pii.find_spans(text)


def test_pii_ibans_before_words():
    """Words in capitals after a grouped IBAN, or before it, are not part of it."""
    accounts = ["ES91 2100 0418 4502 0005 1332", "AT61 1904 3002 3457 3201", "SE45 5000 0000 0583 9825 7466",
                "CZ65 0800 0000 1920 0014 5399", "PL61 1090 1014 0000 0712 1981 2874",
                "HU42 1177 3016 1111 1018 0000 0000", "GB82 WEST 1234 5698 7654 32", "DE89370400440532013000"]

    def ibans(text):
        return [text[s.start:s.end] for s in pii.find_spans(text) if s.kind == "iban"]

    for account in accounts:
        for after in ("", " A", " X", " SA", " BIC", " BANK", " BANK BIC", " BIC INGBESMM", ", BIC", " Bank"):
            assert ibans(f"to {account}{after}") == [account], (account, after)
        assert ibans(f"REF1 AB12 CODE {account}") == [account]
        for other in accounts:
            assert ibans(f"{account} {other}") == [account, other]
    assert ibans("ES91 2100 0418 4502 0005 1333 BIC") == []


def test_pii_report(spark, awkward_docs, awkward, no_docs):
    rows = [(1, "mail é x@y.zz and 10.0.0.256 10.0.0.25 +49 (30) 1234567"), (2, None), (3, ""), (3, "x@y.zz")]
    for frame, source in ((doc_frame(spark, rows), rows), (awkward_docs, awkward)):
        expected = []
        for d, text, *_ in source:
            spans = brute_pii(text)
            joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
            counts = [sum(s[0] == k for s in spans) for k in BASE]
            expected.append((d, *counts, hashlib.sha256(joined.encode()).hexdigest()))
        got = pii.pii_report(frame)
        assert tuples(got, "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256") == ordered(expected)
    assert pii.pii_report(no_docs).count() == 0
    assert pii.pii_spans(awkward_docs).count() == len(awkward)
    assert pii.redacted(doc_frame(spark, rows[:1])).first().text.startswith("mail é [EMAIL] and 10.0.0.256 [IP]")


# quality

def quality_rows(rng, n):
    rows, labels = [], []
    for k in range(n):
        good = rng.random() < 0.7
        text = prose(rng, rng.randint(20, 120))
        if not good:
            text = rng.choice([text.upper().replace(" ", "!! "), " ".join(w + "###" for w in text.split()),
                               " ".join([text.split()[0]] * 80), " | ".join(text.split())])
        rows.append((k, text))
        labels.append((k, int(good), 0))
    return rows, labels


@pytest.fixture(scope="module")
def quality_data(spark):
    rows, labels = quality_rows(random.Random(4), 900)
    return doc_frame(spark, rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"), dict(
        (d, q) for d, q, _ in labels)


def test_quality_held_out(quality_data):
    docs, labels, truth = quality_data
    model = quality.train(docs, labels)
    assert 1 <= len(model.rules) < 150
    got = quality.quality_report(docs, model).collect()
    assert len(got) == len(truth)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= quality.CUT)
    held = [r for r in got if r.held_out]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in got if r.predicted)


def test_quality_never_learns_from_held_out(spark, quality_data):
    docs, labels, _ = quality_data
    from pyspark.sql import functions as F
    flipped = labels.withColumn("quality", F.when(quality.fold(F.col("doc_id")) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert quality.train(docs, flipped) == quality.train(docs, labels)


def test_quality_column_is_the_model(spark, awkward_docs, awkward, quality_data):
    docs, labels, _ = quality_data
    model = quality.train(docs, labels)
    texts = [r[1] for r in awkward]
    x = quality.text_statistics(pd.Series(texts)).to_numpy()
    z = model.intercept + sum(r.weight * quality.holds(r.conditions, x) for r in model.rules)
    expected = sorted(np.round(1 / (1 + np.exp(-z)), 9))
    got = sorted(round(r.score, 9) for r in quality.quality_report(awkward_docs, model).collect())
    assert np.allclose(got, expected)


def test_tree_splits_against_every_cut():
    """Each node's split is the best of all cuts of all statistics, on a small sample, by a plain search."""
    rng = np.random.default_rng(5)
    x = np.round(rng.random((150, len(quality.STATISTICS))) * (rng.random(len(quality.STATISTICS)) < 0.5), 2)
    y = ((x[:, 0] > 0.6) | (x[:, 3] + x[:, 5] > 1.1) | (rng.random(150) < 0.1)).astype(float)
    g, h = np.full(150, y.mean()) - y, np.full(150, y.mean() * (1 - y.mean()))
    cuts = quality._cuts(x)
    bins = np.column_stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)])

    def score(rows):
        return g[rows].sum() ** 2 / (h[rows].sum() + 1)

    def best_gain(rows):
        gains = [0.0]
        for j, column in enumerate(cuts):
            for cut in column:
                low = rows[x[rows, j] <= cut]
                high = rows[x[rows, j] > cut]
                if min(len(low), len(high)) >= quality.LEAST_LEAF:
                    gains.append(score(low) + score(high) - score(rows))
        return max(gains)

    paths, leaves = [], []
    quality._grow(bins, cuts, g, h, np.arange(150), (), 2, paths, leaves)
    assert sorted(np.concatenate([rows for rows, _ in leaves])) == list(range(150)) and len(leaves) >= 3
    for low, high in [(p, q) for p in paths for q in paths if p[:-1] == q[:-1] and not p[-1].above and q[-1].above]:
        parent = np.flatnonzero(quality.holds(low[:-1], x))
        halves = [np.flatnonzero(quality.holds(side, x)) for side in (low, high)]
        assert sorted(np.concatenate(halves)) == list(parent)
        assert score(halves[0]) + score(halves[1]) - score(parent) == pytest.approx(best_gain(parent))
    for rows, value in leaves:
        assert value == pytest.approx(-g[rows].sum() / (h[rows].sum() + 1))
    for path in quality.tree_rules(x, y):  # a tight conjunction selects what its path did
        assert len({(c.statistic, c.above) for c in path}) == len(path) and quality.holds(path, x).sum() >= quality.LEAST_LEAF


@pytest.mark.parametrize("penalty", [0.02, 0.2])
def test_lasso_is_optimal(penalty):
    """The conditions that only the minimum of the penalised loss meets."""
    rng = np.random.default_rng(8)
    z = (rng.random((300, 25)) < rng.random(25)).astype(float)
    y = (1 / (1 + np.exp(-(2 * z[:, 0] - 3 * z[:, 4] + z[:, 7] - 0.5))) > rng.random(300)).astype(float)
    intercept, weights = quality.lasso_logistic(z, y, penalty, steps=20_000)
    scaled = (z - z.mean(axis=0)) / np.maximum(z.std(axis=0), 1e-3)
    bound = penalty * np.abs(scaled.T @ (y - y.mean())).max() / len(y)
    error = 1 / (1 + np.exp(-(intercept + z @ weights))) - y
    slope = scaled.T @ error / len(y)
    used = np.abs(weights) > 1e-9
    assert 0 < used.sum() < 25 and abs(error.mean()) < 1e-6
    assert np.abs(slope[~used]).max() <= bound + 1e-6
    assert np.abs(slope[used] + bound * np.sign(weights[used])).max() < 1e-6


def test_quality_without_labels(spark, awkward_docs, no_docs, quality_data):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    model = quality.train(awkward_docs, none)
    assert {r.score for r in quality.quality_report(awkward_docs, model).collect()} == {0.5}
    one = spark.createDataFrame([(d, 1, 0) for d in range(1, 200)] + [(1, None, None)], none.schema)
    assert min(r.score for r in quality.quality_report(awkward_docs, quality.train(awkward_docs, one)).collect()) > 0.99
    assert quality.train(no_docs, one) == quality.Model(0.0, ())
    assert quality.quality_report(no_docs, model).count() == 0


# decontamination

BENCH_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute_hits(rows, items, n=10):
    windows = []
    for item, text in items:
        words = BENCH_WORD.findall((text or "").translate(LOWER))
        if words:
            k = min(n, len(words))
            windows += [(item, tuple(words[i:i + k])) for i in range(len(words) - k + 1)]
    out = []
    for d, text, *_ in rows:
        words = BENCH_WORD.findall((text or "").translate(LOWER))
        hit, found = set(), set()
        for item, w in set(windows):
            for i in range(len(words) - len(w) + 1):
                if tuple(words[i:i + len(w)]) == w:
                    hit.update(range(i, i + len(w)))
                    found |= {item} - {None}
        out.append((d, len(words), len(hit), sorted(map(str, found)), bool(hit)))
    return ordered(out)


HITS = ("doc_id", "n_words", "n_hit", "items", "contaminated")


def bench(spark, items):
    return spark.createDataFrame([(i, t, "x") for i, t in items], "item_id bigint, text string, words string")


def test_decontamination(spark, awkward_docs, awkward, no_docs):
    base, passage = awkward[0][1].split(), awkward[4][1].split("\t\t")[1].split("\x0b")[0].split()
    items = [(1, " ".join(passage[20:45])), (2, " ".join(passage[20:45])), (10, " ".join(base[:10]).upper()),
             (3, " ".join(base[95:104])), (4, "ONE"), (5, "Words, are"), (6, None), (7, ""), (8, "..."),
             (None, " ".join(base[150:170])), (9, "tick tock " * 6), (11, "σίσυφος İstanbul"), (12, "Σίσυφος İSTANBUL")]
    got = decontam.hit_words(awkward_docs, bench(spark, items))
    assert tuples(got, *HITS) == brute_hits(awkward, items)
    assert not got.filter("n_hit = 0 and contaminated").count()
    assert decontam.hit_words(no_docs, bench(spark, items)).count() == 0
    assert tuples(decontam.hit_words(awkward_docs, bench(spark, items).limit(0)), *HITS) == brute_hits(awkward, [])


def test_a_template_that_all_items_share(spark):
    """Rows that documents join do not depend on how many items share a sentence."""
    rng = random.Random(17)
    template = prose(rng, 12)
    rows = [(k, prose(rng, 20) + " " + template + " " + prose(rng, 20)) for k in range(60)] + [(99, template[:40])]
    for n in (20, 200):
        items = [(k, prose(rng, 15) + " " + template + " " + prose(rng, 15)) for k in range(n)]
        got = decontam.hit_words(doc_frame(spark, rows), bench(spark, items))
        assert tuples(got, *HITS) == brute_hits(rows, items)
        prints = decontam.benchmark_prints(bench(spark, items))
        assert prints.filter(F.size("items") == n).count() == 3  # the windows inside the template


def test_every_shared_window_is_found(spark):
    """Random texts over few words, so that grams tie and repeat; a bitmap of one word lets everything pass."""
    rng = random.Random(9)
    rows = [(k, prose(random.Random(k % 3), rng.randint(0, 60), 4)) for k in range(60)]
    items = [(k, prose(random.Random(k % 3), rng.randint(0, 30), 4)) for k in range(25)]
    for cells in (1, decontam.BITMAP_WORDS):
        got = decontam.hit_words(doc_frame(spark, rows), bench(spark, items), bitmap_words=cells)
        assert tuples(got, *HITS) == brute_hits(rows, items)
