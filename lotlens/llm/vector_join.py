"""Embedding near-dedup by a subspace pigeonhole join.

Vectors of one (not null) label are linked if their cosine is ``SIMILARITY`` or more, that is, if their unit vectors
are at most ``T = sqrt(2 - 2 SIMILARITY)`` apart.

* *Copies* (equal vectors of a label) become one row with their number.
* *Balls.*  Unit vectors are rotated (random signs and Walsh-Hadamard transforms, which keep distances) and laid out by
  range of their sign patterns, so that near copies meet in a task's batch whatever their number.  There, groups of
  ``LEAST_BALL`` or more around a common centre, within ``T / 4``, become one ball; every other vector
  is a ball of its own.  A ball is a rounded centre (16 bits a coordinate) and the exact radius of what it holds.
  All members of a ball are linked to each other.
* *Pigeonhole join.*  Centres are cut into ``BLOCKS`` blocks of coordinates.  If two balls hold a linked pair, their
  centres are at most ``T + a + b`` apart (a, b: the radii), so in at least one block their squared distance is at most
  the block's proportional share of that squared.  Each block is range-joined: a ball lies in the cell of its first coordinate
  there and probes as far as the budget reaches; inside a cell the block's whole squared distance is compared.  A pair that passes in several blocks
  counts in the first.
* *Exact verification.*  The distance d of the centres (exact integers) proves a pair of balls
  wholly linked if d + a + b <= T, and wholly unlinked if d - a - b > T.  The pairs between are expanded
  into their members, and every cosine is computed in doubles from the vectors as given.

*Scale.*  Vectors move when copies are merged and when they are laid out; after that balls
move (a code of 2 bytes a coordinate), twice per block.  A near-copy group of n vectors is n / batch size balls,
so it is not compared pair by pair; links are counted, never made into rows, and connected balls leave a
cell as (ball, smallest ball of its group).  Cells of more than ``CELL`` rows are dealt into pieces that meet pairwise.
In 64 dimensions and at 0.93 a budget is about as wide as the spread of a coordinate, so cells split the work of a
label but prune little of it: the comparison (8 numbers a pair and block) stays quadratic in the number of *balls* of a label.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and those without label, are
linked to nothing; vectors of different length are not linked; rows that share an id are vectors of their
own; a component is named by its smallest id (null only if all its ids are), and a row is kept if its id is that; an empty table
gives an empty result; further columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialised, partitions_for
from .components import components, connected, spread_join

SIMILARITY = 0.93
BLOCKS = 8
#: Vectors that make a ball of several.
LEAST_BALL = 8
#: Leading sign bits whose runs are tried as balls.
RUN_BITS = 12
#: Rows of a cell that are compared in one place.
CELL = 16_384
#: Integer steps to a unit of length.
STEPS = 32_767
#: Room for rounding in proofs by distance.
SLACK = 1e-9

BALL_SCHEMA = ("grp string, ball binary, digest binary, class_id bigint, members bigint, vector binary, "
               "code binary, radius double, total bigint")
PLACED_SCHEMA = "grp string, block int, cell bigint, kind int, ball binary, code binary, radius double, total bigint"
FOUND_SCHEMA = "a binary, b binary, partners bigint, proven boolean"


def _signs(n: int, turn: int) -> np.ndarray:
    """Signs of a turn of the rotation: the same for vectors of the same length everywhere."""
    return np.where(np.random.Generator(np.random.PCG64(1000 * n + turn)).integers(0, 2, n), 1.0, -1.0)


def rotated(x: np.ndarray) -> np.ndarray:
    """Rows in other coordinates (as many as the next power of two, ``BLOCKS`` at least); distances stay."""
    n = max(BLOCKS, 1 << (x.shape[1] - 1).bit_length())
    out = np.zeros((len(x), n))
    out[:, :x.shape[1]] = x
    for turn in range(2):
        out *= _signs(n, turn)
        half = 1
        while half < n:
            pairs = out.reshape(len(x), n // (2 * half), 2, half)
            out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(x), n)
            half *= 2
        out /= math.sqrt(n)
    return out


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _usable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id, grp (label and length; null if linked to nothing), digest, signs, vector (packed doubles)."""
    for batch in batches:
        ids, labels, lists = batch.column(0), batch.column(1).to_pylist(), batch.column(2)
        groups, digests, signs, packed = [], [], [], []
        for label, row in zip(labels, lists, strict=True):
            x = None
            if label is not None and row.is_valid and len(row.values):
                x = row.values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0  # no -0.0
                x = x if np.isfinite(x).all() and x.any() else None
            data = None if x is None else x.tobytes()
            groups.append(None if x is None else f"{len(x)}:{label}")
            digests.append(None if x is None else hashlib.blake2b(f"{label}\0".encode() + data, digest_size=16).digest())
            packed.append(data)
            signs.append(0 if x is None else x)
        for n in {len(s) for s in signs if not isinstance(s, int)}:
            at = [k for k, s in enumerate(signs) if not isinstance(s, int) and len(s) == n]
            turned = rotated(unit(np.stack([signs[k] for k in at])))[:, :62] > 0
            values = turned @ (1 << np.arange(61, 61 - turned.shape[1], -1, dtype=np.int64))
            for k, v in zip(at, values.tolist(), strict=True):
                signs[k] = v
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array(groups, pa.string()), pa.array(digests, pa.binary()), pa.array(signs, pa.int64()),
             pa.array(packed, pa.binary())], ["vec_id", "grp", "digest", "signs", "vector"])


def balls_of(x: np.ndarray, signs: np.ndarray, widest: float) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """(members, code of the centre, radius) for rotated unit vectors of one group, in the order of their sign patterns."""
    left = np.ones(len(x), dtype=bool)
    run = signs >> (62 - RUN_BITS)
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(run)) + 1, [len(run)]])
    for k in np.argsort(-np.diff(cuts), kind="stable"):
        own = np.arange(cuts[k], cuts[k + 1])
        if len(own) < LEAST_BALL:
            break
        own = own[left[own]]
        if len(own) < LEAST_BALL:
            continue
        centre = np.round(x[own].mean(axis=0) * STEPS).astype(np.int64)
        # members that pull the centre away are left out of a second centre
        near = own[((x[own] - centre / STEPS) ** 2).sum(axis=1) <= widest ** 2]
        if len(near) < LEAST_BALL:
            continue
        centre = np.round(x[near].mean(axis=0) * STEPS).astype(np.int64)
        distance = np.sqrt(((x - centre / STEPS) ** 2).sum(axis=1))
        members = np.flatnonzero(left & (distance <= widest))
        if len(members) >= LEAST_BALL:
            left[members] = False
            yield members, centre, float(distance[members].max())
    alone = np.flatnonzero(left)
    codes = np.round(x[alone] * STEPS).astype(np.int64)
    radii = np.sqrt(((x[alone] - codes / STEPS) ** 2).sum(axis=1))
    for k, code, radius in zip(alone, codes, radii.tolist(), strict=True):
        yield np.array([k]), code, radius


def _balls(widest: float):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups = batch.column(0).to_pylist()
            digests, packed = batch.column(1).to_pylist(), batch.column(3).to_pylist()
            members = batch.column(5).to_numpy(zero_copy_only=False)
            signs = batch.column(2).to_numpy(zero_copy_only=False)
            ball: list = [None] * len(groups)
            code: list = [None] * len(groups)
            radius: list = [None] * len(groups)
            total: list = [None] * len(groups)
            cuts = [0, *[k for k in range(1, len(groups)) if groups[k] != groups[k - 1]], len(groups)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                x = rotated(unit(np.stack([np.frombuffer(p) for p in packed[a:b]])))
                for rows, centre, r in balls_of(x, signs[a:b], widest):
                    head = a + int(rows[0])
                    for k in rows:
                        ball[a + int(k)] = digests[head]
                    code[head], radius[head] = centre.astype("<i2").tobytes(), r
                    total[head] = int(members[a + rows].sum())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ball, pa.binary()), batch.column(1), batch.column(4), batch.column(5), batch.column(3),
                 pa.array(code, pa.binary()), pa.array(radius, pa.float64()), pa.array(total, pa.int64())],
                [f.split()[0] for f in BALL_SCHEMA.split(", ")])
    return read


#: Kinds of a ball's rows in a cell: single ones lie in a cell and probe the next; those of several
#: lie in a cell and probe as far as their radius reaches.
LIES, PROBES, WIDE_LIES, WIDE_PROBES = range(4)


def _single_radius(coordinates: int) -> float:
    """What rounding moves a vector of its own at most."""
    return math.sqrt(coordinates) * 0.5 / STEPS * (1 + SLACK)


def _cells(apart: float, widest: float, blocks: int):
    """A row for each cell of each block that a ball lies in or probes."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.array([len(c) // 2 for c in batch.column(2).to_pylist()], dtype=np.int64)
            radius = batch.column(3).to_numpy(zero_copy_only=False)
            for n in np.unique(sizes):
                of_size = np.flatnonzero(sizes == n)
                codes = np.stack([np.frombuffer(batch.column(2)[int(k)].as_py(), dtype="<i2") for k in of_size]).astype(np.int64)
                least = _single_radius(int(n))
                side = (apart + 2 * least) / math.sqrt(blocks) * (1 + 1e-6)
                wide = radius[of_size] > least
                reach = (apart + radius[of_size] + widest) / math.sqrt(blocks) * (1 + 1e-6)
                rows, block, cell, kind = [], [], [], []
                for b in range(blocks):
                    at = codes[:, b * int(n) // blocks] / STEPS
                    own = np.floor(at / side).astype(np.int64)
                    low, high = np.floor((at - reach) / side).astype(np.int64), np.floor((at + reach) / side).astype(np.int64)
                    every = np.arange(len(of_size))
                    parts = [(every, own, np.where(wide, WIDE_LIES, LIES)),
                             (every[~wide], own[~wide] + 1, np.full((~wide).sum(), PROBES))]
                    for step in range(int((high - low).max(initial=-1)) + 1):
                        in_reach = wide & (low + step <= high)
                        parts.append((every[in_reach], (low + step)[in_reach], np.full(in_reach.sum(), WIDE_PROBES)))
                    for r, c, t in parts:
                        rows.append(of_size[r])
                        cell.append(c)
                        kind.append(t)
                        block.append(np.full(len(r), b))
                take = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), pa.array(np.concatenate(block).astype(np.int32)),
                     pa.array(np.concatenate(cell)), pa.array(np.concatenate(kind).astype(np.int32)),
                     batch.column(1).take(take), batch.column(2).take(take), batch.column(3).take(take), batch.column(4).take(take)],
                    [f.split()[0] for f in PLACED_SCHEMA.split(", ")])
    return read


def groups_of(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of the consecutive rows that agree in the first ``keys`` columns."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        rows = list(zip(*[batch.column(k).to_pylist() for k in range(keys)], strict=True))
        start = 0
        for k, key in enumerate(rows):
            if key != last:
                if k > start:
                    held.append(batch.slice(start, k - start))
                if held:
                    yield pa.Table.from_batches(held)
                held, start, last = [], k, key
        if len(rows) > start:
            held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def cell_links(codes: np.ndarray, radius: np.ndarray, total: np.ndarray, kind: np.ndarray, names: np.ndarray,
               side: np.ndarray | None, block: int, blocks: int, apart: float, step: int = 512):
    """Links of a cell's rows: partners and label by row, and the pairs that distance cannot decide.

    ``side`` tells two pieces of a cell apart, of which only pairs across are compared."""
    n, width = codes.shape
    bounds = [b * width // blocks for b in range(blocks)]
    share = np.diff([*bounds, width]) / width
    # a sieve in single precision, wide enough for its rounding; what passes is compared in integers
    own = codes[:, bounds[block]:bounds[block] + int(share[block] * width)].astype(np.float32)
    square = (own * own).sum(axis=1)
    reach = ((apart + radius) * STEPS * math.sqrt(share[block])).astype(np.float32)
    rank = np.unique(names, return_inverse=True)[1]  # rows of one ball have one rank
    of_kind = [np.flatnonzero(kind == k) for k in range(4)]
    of_kind = [k[np.argsort(rank[k])] for k in of_kind]
    partners, label = np.zeros(n), np.arange(n)
    open_i, open_j = [], []

    def compare(rows: np.ndarray, others: np.ndarray, lower: bool) -> None:
        """Each of ``rows`` with ``others``, or with those of lower rank only."""
        nonlocal partners, label
        for a in range(0, len(rows), step):
            one = rows[a:a + step]
            two = others[:np.searchsorted(rank[others], rank[one[-1]])] if lower else others
            budget = (reach[one, None] + (radius[two] * STEPS * math.sqrt(share[block])).astype(np.float32)) ** 2
            both = square[one, None] + square[two]
            mask = both - 2 * (own[one] @ own[two].T) <= budget * np.float32(1 + 1e-5) + both * np.float32(1e-5)
            if lower:
                mask &= rank[one, None] > rank[two]
            if side is not None:
                mask &= side[one, None] != side[two]
            all_i, all_j = np.nonzero(mask)
            for c in range(0, len(all_i), 1 << 15):
                i, j = one[all_i[c:c + (1 << 15)]], two[all_j[c:c + (1 << 15)]]
                squared = np.add.reduceat((codes[i].astype(np.int64) - codes[j]) ** 2, bounds, axis=1)
                allowed = (((apart + radius[i] + radius[j]) * STEPS) ** 2 * (1 + SLACK))[:, None] * share
                passes = squared <= allowed
                first = passes[:, block] & (np.argmax(passes, axis=1) == block)
                i, j = i[first], j[first]
                d = np.sqrt(squared[first].sum(axis=1)) / STEPS
                proven = d + radius[i] + radius[j] <= apart - SLACK
                maybe = ~proven & (d - radius[i] - radius[j] <= apart + SLACK)
                partners += np.bincount(i[proven], total[j[proven]], n) + np.bincount(j[proven], total[i[proven]], n)
                label = connected(label, i[proven], j[proven])
                open_i.append(i[maybe])
                open_j.append(j[maybe])

    compare(of_kind[LIES], of_kind[LIES], True)
    compare(of_kind[PROBES], of_kind[LIES], False)
    compare(of_kind[WIDE_PROBES], of_kind[LIES], False)
    compare(of_kind[WIDE_PROBES], of_kind[WIDE_LIES], True)
    empty = [np.zeros(0, dtype=np.int64)]
    return partners.astype(np.int64), label, np.concatenate(open_i or empty), np.concatenate(open_j or empty)


def _found(apart: float, blocks: int):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups_of(batches, 5):
            names = np.array(table.column("ball").to_pylist(), dtype="S16")
            packed = b"".join(table.column("code").to_pylist())
            codes = np.frombuffer(packed, dtype="<i2").reshape(len(names), -1).astype(np.int32)
            low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
            side = None if low == high else table.column("piece").to_numpy()
            partners, label, i, j = cell_links(
                codes, table.column("radius").to_numpy(), table.column("total").to_numpy(), table.column("kind").to_numpy(),
                names, side, table.column("block")[0].as_py(), blocks, apart)
            balls = table.column("ball").to_pylist()
            linked = np.flatnonzero(partners > 0)
            yield pa.RecordBatch.from_arrays(
                [pa.array([balls[k] for k in [*linked, *i]], pa.binary()), pa.array([balls[k] for k in [*label[linked], *j]], pa.binary()),
                 pa.array([*partners[linked].tolist(), *[0] * len(i)], pa.int64()),
                 pa.array([True] * len(linked) + [False] * len(i), pa.bool_())], ["a", "b", "partners", "proven"])
    return read


def _verified(similarity: float, step: int = 512):
    """Per pair of balls: linked partners of each member (digest, partners), and (a, b) if there are any."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups_of(batches, 2):
            x = np.stack([np.frombuffer(v) for v in table.column("vector").to_pylist()])
            x = x / np.abs(x).max(axis=1, keepdims=True)
            length = np.sqrt((x * x).sum(axis=1))
            second = table.column("second").to_numpy(zero_copy_only=False).astype(bool)
            one, two = np.flatnonzero(~second), np.flatnonzero(second)
            members = table.column("members").to_numpy().astype(np.float64)
            partners = np.zeros(len(x))
            for a in range(0, len(one), step):
                rows = one[a:a + step]
                linked = (x[rows] @ x[two].T) / (length[rows, None] * length[two]) >= similarity
                partners[rows] += linked @ members[two]
                partners[two] += members[rows] @ linked
            some = np.flatnonzero(partners > 0)
            if len(some):
                n = len(some)
                digests = table.column("digest").to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([table.column("a")[0].as_py()] * n, pa.binary()), pa.array([table.column("b")[0].as_py()] * n, pa.binary()),
                     pa.array([digests[k] for k in some], pa.binary()), pa.array(partners[some].astype(np.int64))],
                    ["a", "b", "digest", "partners"])
    return read


def _in_runs(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows of equal keys together, one after the other."""
    return rows.repartition(partitions_for(rows.sparkSession), *keys).sortWithinPartitions(*keys)


def _pieces(placed: DataFrame, most: int) -> DataFrame:
    """``placed`` with low, high and piece: cells of more than ``most`` rows become pairs of pieces."""
    keys = ["grp", "block", "cell"]
    heavy = materialised(placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most), "heavy-cells")
    # known by size from here on: Spark broadcasts it only if it is small
    sized = placed.join(heavy, keys, "left").withColumn("n", F.coalesce(F.ceil(F.col("n") / most), F.lit(1)).cast("int"))
    sized = sized.withColumn("piece", F.pmod(F.xxhash64("ball", "kind"), F.col("n")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("n") - 1))
    return (sized.withColumn("other", other)
            .select(*keys, F.least("piece", "other").alias("low"), F.greatest("piece", "other").alias("high"),
                    "piece", "kind", "ball", "code", "radius", "total"))


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                 similarity: float = SIMILARITY, cell: int = CELL) -> DataFrame:
    """A row per vector: vec_id, n_links (other vectors linked directly), component_id, kept, n_copies (equal vectors)."""
    if not 0 < similarity < 1:
        raise ValueError("similarity must be between 0 and 1")
    apart = math.sqrt(2 - 2 * similarity)
    widest = apart / 4
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"),
                          F.col(vector_col).cast("array<double>").alias("vector"))
    read = materialised(rows.mapInArrow(_usable, "vec_id bigint, grp string, digest binary, signs bigint, vector binary"), "vectors")
    classes = (read.filter("digest is not null").groupBy("grp", "digest", "signs", "vector")
               .agg(F.min("vec_id").alias("class_id"), F.count(F.lit(1)).alias("members"))
               .select("grp", "digest", "signs", "vector", "class_id", "members"))
    order = ("grp", "signs", "digest")
    laid_out = classes.repartitionByRange(partitions_for(vectors.sparkSession), *order).sortWithinPartitions(*order)
    members = materialised(laid_out.mapInArrow(_balls(widest), BALL_SCHEMA), "balls")
    balls = members.filter("code is not null").select("grp", "ball", "code", "radius", "total")
    placed = balls.mapInArrow(_cells(apart, widest, BLOCKS), PLACED_SCHEMA)
    found = materialised(_in_runs(_pieces(placed, cell), "grp", "block", "cell", "low", "high")
                         .mapInArrow(_found(apart, BLOCKS), FOUND_SCHEMA), "vector-links")

    undecided = found.filter("not proven").select("a", "b")
    expanded = [undecided.join(members.select("ball", "digest", "members", "vector"), F.col(own) == F.col("ball"))
                .select("a", "b", F.lit(own == "b").alias("second"), "digest", "members", "vector") for own in ("a", "b")]
    checked = materialised(_in_runs(expanded[0].unionByName(expanded[1]), "a", "b")
                           .mapInArrow(_verified(similarity), "a binary, b binary, digest binary, partners bigint"), "checked-links")

    proven = found.filter("proven")
    roots = components(proven.select("a", "b").union(checked.select("a", "b")))
    of_ball = (members.groupBy("ball").agg(F.min("class_id").alias("low"), F.max("total").alias("total"))
               .join(proven.groupBy("a").agg(F.sum("partners").alias("partners")), F.col("ball") == F.col("a"), "left")
               .join(roots, F.col("ball") == F.col("node"), "left")
               .select("ball", "low", F.coalesce("root", "ball").alias("root"),
                       (F.col("total") - 1 + F.coalesce("partners", F.lit(0))).alias("n_links")))
    of_ball = materialised(of_ball, "linked-balls")
    named = of_ball.groupBy(F.col("root").alias("of_root")).agg(F.min("low").alias("component_id"))
    of_ball = spread_join(of_ball, "root", named, "of_root").select("ball", "n_links", "component_id")
    of_class = (members.join(of_ball, "ball")
                .join(checked.groupBy("digest").agg(F.sum("partners").alias("more")), "digest", "left")
                .select(F.col("digest").alias("class"), (F.col("n_links") + F.coalesce("more", F.lit(0))).alias("n_links"),
                        "component_id", "members"))
    usable = read.filter("digest is not null").select("vec_id", "digest")
    linked = spread_join(usable, "digest", materialised(of_class, "vector-classes"), "class").select(
        "vec_id", "n_links", "component_id", F.col("members").alias("n_copies"))
    alone = read.filter("digest is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"),
                                                 F.lit(1).cast("long").alias("n_copies"))
    return linked.unionByName(alone).select("vec_id", "n_links", "component_id",
                                            F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"), "n_copies")
