"""Quality classifier: a sparse ensemble of rules over text statistics.

1. *Statistics.*  Each whole text becomes a few numbers: shares of character
   classes, word and line repetition, mean word length (``STATISTICS``).
2. *Rules.*  On a bounded sample of labelled rows, shallow boosted trees are
   grown; each path from a root to a node is a conjunction of thresholds.
3. *Lasso.*  A logistic model over the rules' 0/1 columns is fitted with an L1
   penalty, which leaves a few rules with weights.
4. *Compilation.*  The remaining rules are one Spark column expression over
   the statistics; the score is the logistic function of their sum.

Labels are used for training only, and only of rows whose
``crc32(doc_id as text) mod 5`` is not 0.  Neither labels, language, source nor ids enter
a score.  Training takes the ``SAMPLE`` labelled ids with the smallest hash:
that bound is the size of what is broadcast and of what reaches the driver.
Scoring is row by row, without a shuffle, so no key can be skewed.

Defined results: null and empty texts have all statistics 0 and get the score
of those; a document labelled several times counts once, by its mean; a null
label is none; without labels, or with one class only, the score is the share of 1
among the labels (0.5 without any); an empty table gives an empty result; further
columns, whatever their names, are not looked at.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import spare_name

SAMPLE = 20_000
FOLDS, HELD_OUT_FOLD = 5, 0
CUT = 0.3

TREES, DEPTH, LEAST_LEAF, SHRINKAGE, CUTS = 24, 3, 20, 0.3, 32
#: Lasso penalty as a share of the smallest penalty that leaves no rule, and steps of its solver.
PENALTY, STEPS = 0.005, 400

STATISTICS = ("log_bytes", "upper", "symbols", "bangs", "bars", "digits", "stops", "blanks", "non_ascii",
              "mean_word", "same_word", "distinct_words", "same_line")
_CLASSES = {"symbols": b"#$%&*^~<>{}[]\\_=+@", "bangs": b"!?", "bars": b"|", "digits": b"0123456789",
            "stops": b".,;:", "blanks": b" \t\n\x0b\x0c\r"}


class Condition(NamedTuple):
    statistic: str
    above: bool  # value > cut, else value <= cut
    cut: float


class Rule(NamedTuple):
    conditions: tuple[Condition, ...]
    weight: float


class Model(NamedTuple):
    intercept: float
    rules: tuple[Rule, ...]


def text_statistics(texts: pd.Series) -> pd.DataFrame:
    """``STATISTICS`` of each text."""
    raw = [t.encode() if t else b"" for t in texts]
    out = np.zeros((len(raw), len(STATISTICS)))
    full = np.array([k for k, b in enumerate(raw) if b], dtype=np.int64)
    if not len(full):
        return pd.DataFrame(out, columns=list(STATISTICS))
    sizes = np.array([len(raw[k]) for k in full], dtype=np.float64)
    joined = np.frombuffer(b"".join(raw), dtype=np.uint8)
    starts = np.concatenate([[0], np.cumsum(sizes[:-1])]).astype(np.int64)

    def share(members: bytes | np.ndarray) -> np.ndarray:
        table = np.zeros(256, dtype=np.uint8)
        table[np.frombuffer(members, dtype=np.uint8) if isinstance(members, bytes) else members] = 1
        return np.add.reduceat(table[joined], starts, dtype=np.int64) / sizes

    upper, lower = share(np.arange(65, 91)), share(np.arange(97, 123))
    columns = {"log_bytes": np.log1p(sizes), "upper": upper / np.maximum(upper + lower, 1e-9),
               "non_ascii": share(np.arange(128, 256)), **{k: share(v) for k, v in _CLASSES.items()}}
    words_of = np.zeros((4, len(full)))
    for n, k in enumerate(full):
        words = raw[k].split()
        lines = raw[k].split(b"\n")
        if words:
            words_of[0, n] = sum(map(len, words)) / len(words)
            words_of[1, n] = sum(map(bytes.__eq__, words, words[1:])) / len(words)
            words_of[2, n] = len(set(words)) / len(words)
        words_of[3, n] = 1 - len(set(lines)) / len(lines)
    columns |= dict(zip(("mean_word", "same_word", "distinct_words", "same_line"), words_of, strict=True))
    for j, name in enumerate(STATISTICS):
        out[full, j] = columns[name]
    return pd.DataFrame(out, columns=list(STATISTICS))


def with_statistics(df: DataFrame, text_col: str, name: str) -> DataFrame:
    """``df`` with a struct column ``name`` of the text's statistics."""
    udf = F.pandas_udf(text_statistics, ", ".join(f"{s} double" for s in STATISTICS))
    return df.withColumn(name, udf(F.col(text_col)))


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo the folds (a null id: as the empty text)."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(FOLDS))


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> pd.DataFrame:
    """Statistics and ``label`` of at most ``sample`` labelled documents outside the held-out fold."""
    chosen = (labels.filter(F.col("quality").isNotNull() & (fold(F.col("doc_id")) != HELD_OUT_FOLD))
              .groupBy(F.col("doc_id").alias("labelled_id"))
              .agg((F.avg("quality") >= 0.5).cast("double").alias("label"))
              .orderBy(F.xxhash64("labelled_id"), "labelled_id").limit(sample))
    texts = docs.select(F.col("doc_id").alias("id"), F.col("text").alias("text"))
    # at most ``sample`` rows of two numbers
    labelled = texts.join(F.broadcast(chosen), F.col("id") == F.col("labelled_id"))
    rows = with_statistics(labelled.select("id", "label", "text"), "text", "s")
    return (rows.groupBy("id").agg(F.max("label").alias("label"), *[F.max(f"s.{x}").alias(x) for x in STATISTICS])
            .toPandas().sort_values("id").reset_index(drop=True))


def _cuts(x: np.ndarray) -> list[np.ndarray]:
    """Candidate cuts per column: quantiles of the values and of the values above 0 (most shares are mostly 0)."""
    out = []
    for column in x.T:
        found = [np.quantile(part, np.linspace(0.01, 0.99, CUTS)) for part in (column, column[column > 0]) if len(part)]
        cuts = np.unique(np.concatenate(found))
        out.append(cuts[cuts < column.max()])
    return out


def _grow(bins: np.ndarray, cuts: list[np.ndarray], gradient: np.ndarray, hessian: np.ndarray, rows: np.ndarray,
          path: tuple, depth: int, paths: list, leaves: list) -> None:
    """Split ``rows`` where the boosted loss falls most; notes the path of every node and the leaves."""
    if path:
        paths.append(path)
    g, h = gradient[rows], hessian[rows]
    whole = g.sum() ** 2 / (h.sum() + 1.0)
    best = (1e-6, None, None)
    if depth and len(rows) >= 2 * LEAST_LEAF:
        for j, column_cuts in enumerate(cuts):
            b, width = bins[rows, j], len(column_cuts) + 1
            left_g, left_h, left_n = (np.cumsum(np.bincount(b, weights=w, minlength=width))[:-1] for w in (g, h, None))
            right_g, right_h = g.sum() - left_g, h.sum() - left_h
            gain = left_g ** 2 / (left_h + 1.0) + right_g ** 2 / (right_h + 1.0) - whole
            gain[(left_n < LEAST_LEAF) | (len(rows) - left_n < LEAST_LEAF)] = 0
            if len(gain) and gain.max() > best[0]:
                best = (gain.max(), j, int(gain.argmax()))
    if best[1] is None:
        leaves.append((rows, -g.sum() / (h.sum() + 1.0)))
        return
    _, j, k = best
    low = bins[rows, j] <= k
    for side, above in ((low, False), (~low, True)):
        _grow(bins, cuts, gradient, hessian, rows[side], (*path, Condition(STATISTICS[j], above, float(cuts[j][k]))),
              depth - 1, paths, leaves)


def tree_rules(x: np.ndarray, y: np.ndarray) -> list[tuple[Condition, ...]]:
    """The distinct paths of boosted trees, each as tight conjunction."""
    cuts = _cuts(x)
    bins = np.column_stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)])
    margin = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    paths: list[tuple[Condition, ...]] = []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        leaves: list[tuple[np.ndarray, float]] = []
        _grow(bins, cuts, p - y, p * (1 - p), np.arange(len(y)), (), DEPTH, paths, leaves)
        for rows, value in leaves:
            margin[rows] += SHRINKAGE * value
    return list(dict.fromkeys(map(_tight, paths)))


def _tight(path: tuple[Condition, ...]) -> tuple[Condition, ...]:
    """One bound per statistic and side."""
    bounds: dict[tuple[str, bool], float] = {}
    for c in path:
        old = bounds.get((c.statistic, c.above), c.cut)
        bounds[c.statistic, c.above] = max(old, c.cut) if c.above else min(old, c.cut)
    return tuple(Condition(s, above, cut) for (s, above), cut in sorted(bounds.items()))


def holds(rule: tuple[Condition, ...], x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for c in rule:
        column = x[:, STATISTICS.index(c.statistic)]
        out &= (column > c.cut) if c.above else (column <= c.cut)
    return out


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float = PENALTY, steps: int = STEPS) -> tuple[float, np.ndarray]:
    """Intercept and weights of an L1-penalised logistic model, by accelerated proximal gradient."""
    n = len(y)
    mean = z.mean(axis=0)
    spread = np.maximum(z.std(axis=0), 1e-3)
    z = np.column_stack([np.ones(n), (z - mean) / spread])
    largest = np.abs(z[:, 1:].T @ (y - y.mean())).max() / n
    bound = z.T @ (z @ (v := np.ones(z.shape[1]) / np.sqrt(z.shape[1])))
    for _ in range(15):  # power iteration: step length from the largest curvature
        v = bound / np.linalg.norm(bound)
        bound = z.T @ (z @ v)
    rate = 4 * n / (1.05 * np.linalg.norm(bound))
    w = np.zeros(z.shape[1])
    w[0] = np.log(y.mean() / (1 - y.mean()))
    ahead, momentum = w.copy(), 1.0
    for _ in range(steps):
        slope = z.T @ (1 / (1 + np.exp(-np.clip(z @ ahead, -30, 30))) - y) / n
        new = ahead - rate * slope
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - rate * penalty * largest, 0)
        following = (1 + np.sqrt(1 + 4 * momentum ** 2)) / 2
        ahead = new + (momentum - 1) / following * (new - w)
        w, momentum = new, following
    weights = w[1:] / spread
    return float(w[0] - weights @ mean), weights


def fit(rows: pd.DataFrame) -> Model:
    """Rules and weights from training rows (statistics and label)."""
    y = rows["label"].to_numpy(dtype=np.float64)
    if not len(y) or y.min() == y.max():
        share = y.mean() if len(y) else 0.5
        return Model(float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))), ())
    x = rows[list(STATISTICS)].to_numpy(dtype=np.float64)
    paths = tree_rules(x, y)
    if not paths:
        return Model(float(np.log(y.mean() / (1 - y.mean()))), ())
    z = np.column_stack([holds(p, x) for p in paths]).astype(np.float64)
    intercept, weights = lasso_logistic(z, y)
    return Model(intercept, tuple(Rule(p, float(w)) for p, w in zip(paths, weights, strict=True) if abs(w) > 1e-4))


def score_column(model: Model, statistics: str) -> Column:
    """The model as an expression over the struct column ``statistics``."""
    total = F.lit(model.intercept)
    for rule in model.rules:
        met = F.lit(True)
        for c in rule.conditions:
            value = F.col(f"{statistics}.{c.statistic}")
            met = met & ((value > c.cut) if c.above else (value <= c.cut))
        total = total + F.when(met, F.lit(rule.weight)).otherwise(F.lit(0.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    return fit(training_rows(docs, labels, sample))


def quality_report(docs: DataFrame, model: Model) -> DataFrame:
    """A row per document: doc_id, held_out, score, predicted."""
    rows = with_statistics(docs.select("doc_id", "text"), "text", "s")
    return (rows.select("doc_id", (fold(F.col("doc_id")) == HELD_OUT_FOLD).alias("held_out"),
                        score_column(model, "s").alias("score"))
            .select("*", (F.col("score") >= CUT).cast("int").alias("predicted")))


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The documents whose score reaches ``CUT``, with their columns."""
    name = spare_name(docs, "statistics")
    return with_statistics(docs, "text", name).filter(score_column(model, name) >= CUT).drop(name)
