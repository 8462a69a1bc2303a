"""N-gram Jaccard join by chosen paths: split on sampled shared tokens, brute-force small buckets, repeat.

Documents are sets of ``SHINGLE``-word shingles (a shorter text is one
shingle of all its words).  Two *classes* (a class is all documents of one
text) are linked if their sets' Jaccard similarity is ``SIMILARITY`` or more.

* *Tokens.*  Each set is embedded as ``COORDINATES`` min-hash tokens; two sets
  of similarity s share each token with probability s.
* *Paths.*  A run starts with all sets in one bucket.  A bucket is split on
  ``BRANCHES`` coordinates that its path chooses, and each set goes to the
  children named by its tokens there.  A linked pair follows at least
  one child together with probability 1 - (1 - s p)^BRANCHES if p is that of
  surviving below; the smallest fixed point at s = 0.8 and two branches is
  p = 0.9375, at any depth.  Runs are repeated until the pairs at exactly
  0.8 are found with ``RECALL`` (three runs: 0.9998); those above, with more.
* *Balls.*  Jaccard distance is a metric: sets within half the allowed distance (0.1) of one other set are all linked to
  each other.  Each large first-level bucket of the first root gets a centre, the shingles that most of its sets hold; the sets around it are a
  ball, counted as such and never compared with each other again, in any bucket.  So a tight group of near copies costs
  a comparison with its centre for each, however large it is.
* *Splitting ends* with at most ``SMALL`` sets, which are brute-forced.  A split is kept only if it saves work,
  that is, if the squares of the children's sizes add up to less than the parent's: in a bucket of mostly near copies they
  do not (tokens agree in half of all pairs or more, and splitting would only multiply rows).  Such a bucket, and
  what ``DEPTH`` splits have left, is brute-forced in blocks of ``SMALL`` by ``SMALL``.
* *Brute force.*  Token agreement first (a pair at 0.8 shows less than
  ``LEAST_AGREEMENT`` with probability 1e-4), then the exact similarity on the whole
  shingle sets: a set's common shingles with all others of its bucket are counted at once, from the lists of the sets that
  hold each shingle.  Jaccard distance is a metric, so sets within half the allowed distance of one pivot are linked to each other
  without being compared; buckets of near copies are taken apart by such pivots first.
  Of a pair's first-level buckets that were not split, the first one
  compares it and no other bucket does; only pairs without such a bucket can be met twice.
* *Links* are never rows: each bucket says per set how many partners it has found (their names,
  where a pair can be met twice) and which sets it connects.

*Scale.*  Copies are collapsed before anything else, so a group of equal
texts is one set.  Buckets move ids only; tokens (256 bytes) move for buckets
with two sets or more; whole sets move for sets with a surviving candidate, once per
bucket they are compared in, and only their texts are read again (a bitmap of fixed size
keeps the others from being shuffled).  Candidates stay packed, a row per bucket.  No bucket is collected before its
size is known: sizes are a written table of the buckets of two sets or more, and rows meet it in a join that Spark can
split where a bucket is large.  Of a large bucket that no split thins out, the sets
around its centre meet only those that are not; a *loose* group (linked to each other, but further than 0.1 from the centre) of n
is n / ``SMALL`` blocks, each met by each: its rows grow with n squared / ``SMALL`` once n is beyond ``SMALL``.

Defined results: texts without words are linked to nothing (their copies
still form a class); a null text is empty; rows that share an id are documents of their
own if their texts differ; classes and links are named by the smallest doc_id of the
class (null ids last); rows that repeat an id and a text are copies; an empty table gives empty results; further columns, whatever
their names, are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bitmap, in_bitmap, materialised, spare_name, whole_text
from .components import components, connected, spread_join
from .words import blocks, find_words, mixed, window_hashes

SHINGLE = 5
SIMILARITY = 0.8
COORDINATES = 64
BRANCHES = 2
DEPTH = 8
SMALL = 2048
#: 64-bit words of the bitmap that tells which texts are read again.
BITMAP_WORDS = 1 << 15
#: Bytes of texts that are made into shingles at a time (some fifty times as many of memory).
BLOCK_BYTES = 1 << 20
#: Places that are gathered at once when common shingles are counted.
GATHERED = 1 << 20
RECALL = 0.999
#: Share of common tokens under which a pair is not compared exactly.
LEAST_AGREEMENT = 0.58

TOKEN_SCHEMA = "doc_id bigint, digest binary, n_shingles int, tokens binary"


def runs_for(recall: float = RECALL, similarity: float = SIMILARITY, branches: int = BRANCHES) -> int:
    """Runs after which a pair of just ``similarity`` is found with probability ``recall``."""
    p = 1.0
    for _ in range(200):
        p = 1 - (1 - similarity * p) ** branches
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - p)))


def shingle_sets(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the texts' shingles, one text after the other, and where each text's begin (and the end).

    A text of fewer than ``n`` words, but not none, has one shingle.
    """
    words = find_words(texts)
    hashes, whole = window_hashes(words, n)
    counts = np.diff(words.first)
    for k in np.flatnonzero((counts > 0) & (counts < n)):
        a, b = words.first[k], words.first[k + 1]
        total = np.uint64(b - a)
        for h in words.hashes[a:b]:
            total = mixed(np.array([total ^ h], dtype=np.uint64))[0] + np.uint64(1)
        hashes[a], whole[a] = total, True
    before = np.concatenate([[0], np.cumsum(whole)])
    return hashes[whole], before[words.first]


def min_tokens(hashes: np.ndarray, first: np.ndarray, coordinates: int) -> np.ndarray:
    """Min-hash tokens of each set (a row each; zeros for empty sets)."""
    full = np.flatnonzero(np.diff(first) > 0)
    out = np.zeros((len(first) - 1, coordinates), dtype=np.uint32)
    if len(full):
        narrow = (hashes >> np.uint64(32)).astype(np.uint32)
        keys = mixed(np.arange(1, 2 * coordinates + 1, dtype=np.uint64))
        for j in range(coordinates):
            salted = (narrow ^ np.uint32(keys[2 * j] >> np.uint64(32))) * np.uint32((keys[2 * j + 1] >> np.uint64(32)) | np.uint64(1))
            out[full, j] = np.minimum.reduceat(salted, first[full])
    return out


def _tokens(shingle: int, coordinates: int):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.encode() for t in batch.column(1).to_pylist()]
            for a, b in blocks(texts, BLOCK_BYTES):
                hashes, first = shingle_sets(texts[a:b], shingle)
                tokens = [t.tobytes() for t in min_tokens(hashes, first, coordinates)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b], batch.column(2)[a:b], pa.array(np.diff(first).astype(np.int32)), pa.array(tokens, pa.binary())],
                    ["doc_id", "digest", "n_shingles", "tokens"])
    return read


def _sets(shingle: int):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.encode() for t in batch.column(1).to_pylist()]
            for a, b in blocks(texts, BLOCK_BYTES):
                hashes, first = shingle_sets(texts[a:b], shingle)
                found = [np.unique(hashes[first[k]:first[k + 1]].view(np.int64)) for k in range(b - a)]
                ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b], pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found)))],
                    ["set_id", "shingles"])
    return read


def text_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                 coordinates: int = COORDINATES) -> tuple[DataFrame, DataFrame]:
    """Members (doc_id, digest) and classes (set_id, digest, class_doc, n_shingles, tokens), written out.

    ``set_id`` numbers the classes by a hash of their text.
    """
    text = whole_text(text_col)
    read = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text.alias("text"),
                       F.unhex(F.sha2(text, 256)).alias("digest"))
    rows = materialised(read.mapInArrow(_tokens(shingle, coordinates), TOKEN_SCHEMA), "min-tokens")
    # the text decides its tokens, so they may be keys as well: all buffers are plain numbers
    classes = rows.groupBy("digest", "n_shingles", "tokens").agg(
        F.min("doc_id").alias("class_doc"), F.count(F.lit(1)).alias("members"))
    return rows.select("doc_id", "digest"), classes


def _token(at: Column | int) -> Column:
    """Token of a coordinate: 4 of the packed bytes."""
    return F.substring(F.col("tokens"), F.lit(4) * at + 1, F.lit(4))


def _tokens_at(path: Column, branches: int, used: int, coordinates: int) -> Column:
    """Child paths of ``path``: each of ``branches`` different coordinates from ``used`` on, with the set's token."""
    free = coordinates - used
    first = F.pmod(F.xxhash64(path), F.lit(free))
    step = 1 + F.pmod(F.xxhash64(path, F.lit(1)), F.lit(free // branches - 1))
    places = [(F.lit(used) + F.pmod(first + step * j, F.lit(free))).cast("int") for j in range(branches)]
    return F.array(*[F.xxhash64(path, c, _token(c)) for c in places])


def _among(rows: DataFrame, key: Column, wanted: DataFrame) -> DataFrame:
    """``rows`` whose ``key`` (a bigint) may be a ``hash`` of ``wanted``: a bitmap of fixed size keeps most others from being shuffled.

    The bitmap is written out: Spark plans a scalar subquery anew wherever a filter is pushed to, with all that it is made of.
    """
    cells = materialised(bitmap(wanted, BITMAP_WORDS), "bitmap").scalar()
    return (rows.withColumn("cells", cells).withColumn("key_hash", key)
            .filter(in_bitmap("cells", "key_hash", BITMAP_WORDS)).drop("cells", "key_hash"))


def _sizes(level: DataFrame) -> DataFrame:
    """path, parent, size of the buckets of a level, written out."""
    return materialised(level.groupBy("path", "parent").agg(F.count(F.lit(1)).alias("size")), "bucket-sizes")


def shingle_rows(docs: DataFrame, classes: DataFrame, wanted: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """set_id (digest), shingles of the classes whose digests ``wanted`` has; only their texts are shuffled, one per class."""
    one_each = materialised(wanted.select("digest").distinct().join(classes.select("digest", "class_doc"), "digest"), "wanted")
    text = whole_text(text_col)
    texts = _among(docs.select(F.unhex(F.sha2(text, 256)).alias("text_digest"), F.col(id_col).cast("bigint").alias("id"),
                               text.alias("text")), F.xxhash64("text_digest"), one_each.select(F.xxhash64("digest").alias("hash")))
    chosen = (texts.select("text_digest", "id", "text")
              .join(one_each, (F.col("text_digest") == one_each["digest"]) & F.col("id").eqNullSafe(one_each["class_doc"]))
              .select("text_digest", "text"))
    return chosen.mapInArrow(_sets(shingle), "set_id binary, shingles array<bigint>").dropDuplicates(["set_id"])


def near_copy_balls(large: DataFrame, shingles_of: Callable[[DataFrame], DataFrame], similarity: float, small: int) -> DataFrame:
    """digest, ball: sets of large first-level buckets (path, root, digest; more than ``small`` sets in each) within half the
    allowed distance of a centre, written out; a ball is called by one of its digests.

    The centre of a bucket of the first root is the set of the shingles that more than half of its sets hold.  Sets that miss that bucket
    by its token are held against the centre of the ball that most of their other buckets' sets belong to.  All sets of a ball are
    linked to each other.  Everything here is linear in the shingles of the buckets.
    """
    def near(shingles: str, centre: str) -> Column:
        shared = F.size(F.array_intersect(shingles, centre))
        return shared >= F.lit(1 - (1 - similarity) / 2 + 1e-9) * (F.size(shingles) + F.size(centre) - shared)

    first = large.filter("root = 0").select("path", "digest")
    found = materialised(shingles_of(first), "hot-sets")
    members = materialised(first.join(found, F.col("digest") == F.col("set_id")).select("path", "digest", "shingles"), "hot-members")
    sizes = members.groupBy(F.col("path").alias("of_path")).agg(F.count(F.lit(1)).alias("size"))
    frequent = (members.select("path", F.explode("shingles").alias("shingle")).groupBy("path", "shingle")
                .agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > small // 2))
    centres = materialised(frequent.join(sizes, F.col("path") == F.col("of_path")).filter(2 * F.col("n") > F.col("size"))
                           .groupBy(F.col("path").alias("centre_path")).agg(F.collect_list("shingle").alias("centre")), "centres")
    close = materialised(spread_join(members, "path", centres, "centre_path").filter(near("shingles", "centre"))
                         .select("path", "digest"), "close")
    names = materialised(close.groupBy(F.col("path").alias("of_path")).agg(F.min("digest").alias("ball")), "ball-names")
    balls = materialised(spread_join(close, "path", names, "of_path").select("digest", "ball"), "balls")

    later = large.filter("root > 0").select("path", "digest").join(balls, "digest", "left")
    later = materialised(later, "later")
    mains = (later.filter("ball is not null").groupBy("path", "ball").agg(F.count(F.lit(1)).alias("n"))
             .groupBy(F.col("path").alias("of_path")).agg(F.max(F.struct("n", "ball"))["ball"].alias("main")))
    tries = materialised(spread_join(materialised(later.filter("ball is null").select("path", "digest"), "left"), "path", mains, "of_path")
                         .select("digest", "main").distinct(), "tries")
    tried = materialised(tries.join(shingles_of(tries), F.col("digest") == F.col("set_id")).select("digest", "main", "shingles"), "tried")
    centre_of = names.join(centres, F.col("of_path") == F.col("centre_path")).select("ball", "centre")
    more = (spread_join(tried, "main", centre_of, "ball").filter(near("shingles", "centre"))
            .groupBy("digest").agg(F.min("ball").alias("ball")))
    return materialised(balls.unionByName(more), "all-balls")


def chosen_path_buckets(classes: DataFrame, runs: int, branches: int = BRANCHES, depth: int = DEPTH,
                        small: int = SMALL, coordinates: int = COORDINATES,
                        balls_of: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Buckets to brute-force (path, root, digest, side, alone), sets with open roots (digest, open), and balls (digest, ball).

    ``root`` numbers a bucket's first branch; the bit of a root is open for a set if its
    first-level bucket there was split, so that pairs in it may have been missed.
    ``balls_of`` finds the balls of the large buckets of the first root; there are none (None) without such buckets.
    """
    sets = classes.filter("n_shingles > 0")
    roots = runs * branches
    first = F.array(*[F.struct(F.lit(j).alias("root"), F.xxhash64(F.lit(j), _token(F.lit(j))).alias("path"))
                      for j in range(roots)])
    level = sets.select("digest", F.explode(first).alias("r")).select(
        "digest", "r.root", "r.path", F.lit(None).cast("long").alias("parent"))
    sizes, done, opened, balls, d = _sizes(level), [], None, None, 0
    while True:
        shared = sizes.filter("size > 1").select("path", "size")
        sized = materialised(_among(level.drop("parent"), F.col("path"), shared.select(F.col("path").alias("hash")))
                             .join(shared, "path"), f"paths-{d}")
        done.append(sized.filter(F.col("size") <= small)
                    .select("path", "root", "digest", F.lit(0).alias("side"), F.lit(True).alias("alone")))
        if sizes.filter(F.col("size") > small).isEmpty():
            break
        large = sized.filter(F.col("size") > small)
        if d == 0 and balls_of is not None:
            balls = None if large.filter("root = 0").isEmpty() else balls_of(large.select("path", "root", "digest"))
        d += 1
        if d == depth:
            done.append(_block_pairs(large, small, balls))
            break
        below = (large.join(_among(sets.select("digest", "tokens"), F.xxhash64("digest"),
                                   large.select(F.xxhash64("digest").alias("hash"))), "digest")
                 .select("digest", "root", F.col("path").alias("parent"),
                         F.explode(_tokens_at(F.col("path"), branches, roots, coordinates)).alias("path")))
        below = materialised(below, f"below-{d}")  # counted and, where the split is kept, dealt
        children = _sizes(below)
        # the children hold ``branches`` rows for each set of their parent
        futile = materialised(children.groupBy("parent").agg(
            F.sum(F.col("size").cast("double") * F.col("size")).alias("work"), (F.sum("size") / branches).alias("sets"))
            .filter("work >= sets * sets").select(F.col("parent").alias("whole")), f"futile-{d}")
        whole = large.join(futile, F.col("path") == F.col("whole"), "left_semi")
        done.append(_block_pairs(whole, small, balls))
        if d == 1:
            split = large.join(futile, F.col("path") == F.col("whole"), "left_anti")
            opened = split.groupBy("digest").agg(F.bit_or(F.expr("shiftleft(1L, root)")).alias("open"))
        level = below.join(futile, F.col("parent") == F.col("whole"), "left_anti")
        sizes = children.join(futile, F.col("parent") == F.col("whole"), "left_anti")
    if opened is None:
        opened = sets.select("digest", F.lit(0).cast("long").alias("open")).limit(0)
    return reduce(DataFrame.unionByName, done), opened, balls


def _block_pairs(large: DataFrame, small: int, balls: DataFrame | None) -> DataFrame:
    """Large buckets as pairs of blocks: side 0 meets side 1, or itself if alone.

    The sets of a bucket's largest ball are linked to each other already: their blocks only meet those of the others."""
    if balls is None:
        sized = large.withColumns({"main": F.lit(False), "inside": F.lit(0)})
    else:
        named = materialised(large.join(balls, "digest", "left"), "blocked")
        mains = (named.filter("ball is not null").groupBy("path", "ball").agg(F.count(F.lit(1)).alias("n"))
                 .groupBy(F.col("path").alias("of_path")).agg(F.max(F.struct("n", "ball")).alias("most")))
        # a row per large bucket that has a ball
        sized = named.join(materialised(mains, "main-balls"), F.col("path") == F.col("of_path"), "left").withColumns({
            "main": F.coalesce(F.col("ball") == F.col("most.ball"), F.lit(False)),
            "inside": F.coalesce(F.ceil(F.col("most.n") / F.lit(small)), F.lit(0)).cast("int"),
            "size": F.col("size") - F.coalesce("most.n", F.lit(0))})
    others = F.ceil(F.col("size") / F.lit(small)).cast("int")
    sized = sized.withColumns({"n": F.col("inside") + others, "block": F.when(
        F.col("main"), F.pmod(F.xxhash64("digest", "path"), F.col("inside"))).otherwise(
        F.col("inside") + F.pmod(F.xxhash64("digest", "path"), F.greatest(others, F.lit(1)))).cast("int")})
    met = F.filter(F.sequence(F.lit(0), F.greatest(F.col("n"), F.lit(1)) - 1),
                   lambda other: (other < F.col("n")) & ~(F.col("main") & (other < F.col("inside"))))
    pairs = F.transform(met, lambda other: F.struct(
        F.least("block", other).alias("low"), F.greatest("block", other).alias("high"),
        (F.col("block") > other).cast("int").alias("side")))
    return (sized.select("digest", "root", "path", F.explode(pairs).alias("p"))
            .select(F.xxhash64("path", "p.low", "p.high").alias("path"), "root", "digest", "p.side",
                    (F.col("p.low") == F.col("p.high")).alias("alone")))


def _agreeing(tokens: np.ndarray, sides: np.ndarray, opened: np.ndarray, balls: np.ndarray, root: int, alone: bool, least: float,
              roots: int) -> np.ndarray:
    """Pairs (i < j) of a bucket's sets with enough common tokens that neither an earlier bucket compares nor a ball links."""
    found = []
    for i in range(len(tokens) - 1):
        others = np.arange(i + 1, len(tokens)) if alone else i + 1 + np.flatnonzero(sides[i + 1:] != sides[i])
        if balls[i] >= 0:
            others = others[balls[others] != balls[i]]
        # half of the tokens sieve out most of the others
        half = tokens.shape[1] // 2
        agree = (tokens[others, :half] == tokens[i, :half]).sum(axis=1)
        some = np.flatnonzero(agree + (tokens.shape[1] - half) >= least * tokens.shape[1])
        some = some[agree[some] >= (least - 0.3) * half]
        others, agree = others[some], agree[some]
        agree = agree + (tokens[others, half:] == tokens[i, half:]).sum(axis=1)
        others = others[agree >= least * tokens.shape[1]]
        for other in range(roots) if opened[i] >> root & 1 else range(root):
            if len(others) and not opened[i] >> other & 1:
                others = others[tokens[others, other] != tokens[i, other]]
        if len(others):
            found.append(np.stack([np.full(len(others), i), others], axis=1))
    return np.concatenate(found).astype(np.int32) if found else np.zeros((0, 2), dtype=np.int32)


def _candidates(least: float, roots: int):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, members, pairs, again = [], [], [], []
            for path, rows in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = pa.RecordBatch.from_struct_array(rows.values)
                digests = rows.column(rows.schema.get_field_index("digest")).to_pylist()
                packed = rows.column(rows.schema.get_field_index("tokens")).to_pylist()
                tokens = np.frombuffer(b"".join(packed), dtype=np.uint32).reshape(len(packed), -1)
                sides, opened, root, alone = (rows.column(rows.schema.get_field_index(c)).to_numpy(zero_copy_only=False)
                                              for c in ("side", "open", "root", "alone"))
                names: dict[bytes, int] = {}
                balls = np.array([-1 if x is None else names.setdefault(x, len(names))
                                  for x in rows.column(rows.schema.get_field_index("ball")).to_pylist()])
                found = _agreeing(tokens, sides, opened, balls, int(root[0]), bool(alone[0]), least, roots)
                if len(found):
                    used = np.unique(found)
                    paths.append(path)
                    members.append([digests[k] for k in used])
                    pairs.append(np.searchsorted(used, found).astype("<i4").tobytes())
                    again.append(bool(int(opened[0]) >> int(root[0]) & 1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(paths, pa.int64()), pa.array(members, pa.list_(pa.binary())), pa.array(pairs, pa.binary()),
                 pa.array(again, pa.bool_())], ["path", "members", "pairs", "again"])
    return read


class _Holders:
    """The sets of a bucket by shingle: common shingles of one set with all others at once."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sizes = np.array([len(x) for x in sets])
        self.first = np.concatenate([[0], np.cumsum(self.sizes)])
        _, self.place = np.unique(np.concatenate(sets), return_inverse=True)
        order = np.argsort(self.place, kind="stable")
        self.holder = np.repeat(np.arange(len(sets)), self.sizes)[order]
        self.counts = np.bincount(self.place)
        self.starts = np.cumsum(self.counts) - self.counts

    def similarity(self, k: int) -> np.ndarray:
        """Jaccard similarity of set k with every set."""
        n, shared = len(self.sizes), None
        own = self.place[self.first[k]:self.first[k + 1]]
        step = max(1, GATHERED // n)  # no shingle has more holders than there are sets
        for a in range(0, len(own), step):
            mine = own[a:a + step]
            counts = self.counts[mine]
            ends = np.cumsum(counts)
            at = np.repeat(self.starts[mine] - (ends - counts), counts) + np.arange(ends[-1])
            found = np.bincount(self.holder[at], minlength=n)
            shared = found if shared is None else shared + found
        return shared / (self.sizes[k] + self.sizes - shared)


def linked_pairs(sets: list[np.ndarray], pairs: np.ndarray, similarity: float) -> np.ndarray:
    """Those of ``pairs`` (i, j) of sorted sets whose similarity is ``similarity`` or more, compared exactly."""
    if not len(pairs):
        return pairs
    least, half = similarity - 1e-12, 1 - (1 - similarity) / 2 + 1e-9
    if len(pairs) <= 4 * len(sets):  # few of all: one by one
        shared = np.array([_common(sets[i], sets[j]) for i, j in pairs])
        sizes = np.array([len(x) for x in sets])
        return pairs[shared >= least * (sizes[pairs[:, 0]] + sizes[pairs[:, 1]] - shared)]
    holders, linked = _Holders(sets), []
    while len(pairs):
        # the set of the most pairs: its own pairs are decided, and many of those between others
        pivot = np.bincount(pairs.ravel(), minlength=len(sets)).argmax()
        near = holders.similarity(pivot)
        own = (pairs == pivot).any(axis=1)
        other = pairs[own].sum(axis=1) - pivot
        linked.append(pairs[own][near[other] >= least])
        # both close to the pivot: linked; one further from it than the other by more than a link allows: not linked
        inside = ~own & (near >= half)[pairs].all(axis=1)
        apart = np.abs(near[pairs[:, 0]] - near[pairs[:, 1]]) > 1 - similarity + 1e-9
        linked.append(pairs[inside])
        decided = inside.sum() + (apart & ~own).sum()
        pairs = pairs[~own & ~inside & ~apart]
        if decided < len(sets):  # no longer worth a pass over all pairs
            break
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(pairs[:, 0])) + 1, [len(pairs)]]) if len(pairs) else []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        linked.append(pairs[a:b][holders.similarity(pairs[a, 0])[pairs[a:b, 1]] >= least])
    return np.concatenate(linked)


def _common(x: np.ndarray, y: np.ndarray) -> int:
    """Members that two sorted sets share."""
    if len(x) > len(y):
        x, y = y, x
    place = np.searchsorted(y, x)
    return int((y[np.minimum(place, len(y) - 1)] == x).sum())


def _verified(similarity: float):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for k in range(batch.num_rows):
                members, again = batch.column(0)[k].as_py(), batch.column(2)[k].as_py()
                sets = [x.values.to_numpy() for x in batch.column(3)[k]]
                pairs = np.frombuffer(batch.column(1)[k].as_py(), dtype="<i4").reshape(-1, 2).astype(np.int64)
                linked = linked_pairs(sets, pairs, similarity)
                # labels by name, so that the smallest digest names a group
                rank = np.argsort(np.argsort(np.array(members, dtype="S32")))
                by_rank = np.argsort(rank)
                label = by_rank[connected(np.arange(len(members)), rank[linked[:, 0]], rank[linked[:, 1]])[rank]]
                counts = np.bincount(linked.ravel(), minlength=len(members))
                names: list[list[int]] = [[] for _ in members]
                if again:
                    hashed = [int.from_bytes(m[:8], "big", signed=True) for m in members]
                    for i, j in linked.tolist():
                        names[i].append(hashed[j])
                        names[j].append(hashed[i])
                out += [(members[at], members[label[at]], 0 if again else int(counts[at]), names[at])
                        for at in np.flatnonzero(counts)]
            columns = list(zip(*out, strict=True)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.binary(), pa.int64(), pa.list_(pa.int64())), strict=True)],
                ["digest", "label", "partners", "others"])
    return read


def jaccard_partners(docs: DataFrame, classes: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  shingle: int = SHINGLE, similarity: float = SIMILARITY, recall: float = RECALL,
                  small: int = SMALL, depth: int = DEPTH, coordinates: int = COORDINATES,
                  least_agreement: float = LEAST_AGREEMENT) -> DataFrame:
    """Per bucket and linked class: digest, label (smallest digest that the bucket connects it with),
    partners (links that no other bucket finds), others (hashes of those that another may find too)."""
    runs = runs_for(recall, similarity)

    def shingles_of(wanted: DataFrame) -> DataFrame:
        return shingle_rows(docs, classes, wanted, id_col, text_col, shingle)

    members, opened, balls = chosen_path_buckets(
        classes, runs, BRANCHES, depth, small, coordinates,
        lambda hot: near_copy_balls(hot, shingles_of, similarity, small))
    members = materialised(members, "compared")  # a union over all levels, read twice below
    sets = _among(classes.select("digest", "tokens"), F.xxhash64("digest"), members.select(F.xxhash64("digest").alias("hash")))
    sets = sets.withColumn("ball", F.lit(None).cast("binary")) if balls is None else sets.join(balls, "digest", "left")
    buckets = (members.join(sets, "digest").join(opened, "digest", "left")
               .groupBy("path").agg(F.collect_list(F.struct(
                   "digest", "tokens", "root", "side", "alone", "ball",
                   F.coalesce("open", F.lit(0).cast("long")).alias("open"))).alias("rows")))
    candidates = materialised(buckets.mapInArrow(
        _candidates(least_agreement, runs * BRANCHES),
        "path bigint, members array<binary>, pairs binary, again boolean"), "candidates")
    # whole shingle sets of the classes that have a candidate, each once per bucket it is compared in
    needed = candidates.select("path", F.posexplode("members").alias("at", "digest"))
    found = shingles_of(needed)
    groups = (needed.join(found, needed["digest"] == found["set_id"]).groupBy("path")
              .agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "shingles"))), lambda x: x.shingles).alias("sets")))
    links = candidates.join(groups, "path").select("members", "pairs", "again", "sets").mapInArrow(
        _verified(similarity), "digest binary, label binary, partners bigint, others array<bigint>")
    if balls is None:
        return links
    linked = balls.groupBy(F.col("ball").alias("of_ball")).agg((F.count(F.lit(1)) - 1).alias("partners"))
    return links.unionByName(spread_join(balls, "ball", linked, "of_ball").select(
        "digest", F.col("ball").alias("label"), "partners", F.array().cast("array<bigint>").alias("others")))


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                           **options) -> tuple[DataFrame, DataFrame]:
    """Members (doc_id, digest), and per class: digest, class_doc, members, n_links, class_id, first_digest.

    ``first_digest`` is the class that stays of those that links connect.
    """
    members, classes = text_classes(docs, id_col, text_col, options.get("shingle", SHINGLE),
                                    options.get("coordinates", COORDINATES))
    classes = materialised(classes, "classes")
    links = materialised(jaccard_partners(docs, classes, id_col, text_col, **options), "links")
    degrees = links.groupBy("digest").agg(
        (F.sum("partners") + F.size(F.array_distinct(F.flatten(F.collect_list("others"))))).alias("n_links"))
    linked = links.filter("digest != label").select(F.col("digest").alias("a"), F.col("label").alias("b"))
    named = (classes.select("digest", "class_doc", "members").join(degrees, "digest", "left")
             .join(components(linked).withColumnRenamed("node", "digest"), "digest", "left")
             .select("digest", "class_doc", "members", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
                     F.coalesce("root", "digest").alias("root")))
    named = materialised(named, "named-classes")
    groups = named.groupBy("root").agg(
        F.min(F.struct(F.col("class_doc").isNull().alias("nameless"), "class_doc", "digest")).alias("first"))
    groups = groups.withColumnRenamed("root", "group_root")
    return members, spread_join(named, "root", groups, "group_root").select(
        "digest", "class_doc", "members", "n_links", F.col("first.class_doc").alias("class_id"),
        F.col("first.digest").alias("first_digest"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """A row per document: doc_id, class_id (smallest id of the documents that links and copies connect),
    copy_id (smallest id of the equal texts), n_copies, n_links (linked classes)."""
    members, classes = near_duplicate_classes(docs, id_col, text_col, **options)
    return members.join(classes, "digest").select(
        "doc_id", "class_id", F.col("class_doc").alias("copy_id"), F.col("members").alias("n_copies"), "n_links")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each group that copies and links connect: that of the smallest id."""
    members, classes = near_duplicate_classes(docs, id_col, text_col, **options)
    id_name, digest_name = spare_name(docs, "kept_id"), spare_name(docs, "kept_digest")
    kept = classes.filter("digest = first_digest").select(
        F.col("class_doc").alias(id_name), F.col("digest").alias(digest_name))
    out = docs.join(kept, docs[id_col].eqNullSafe(kept[id_name])
                    & (F.unhex(F.sha2(whole_text(docs[text_col]), 256)) == kept[digest_name]), "left_semi")
    repeated = members.groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return out if repeated.isEmpty() else out.dropDuplicates([id_col, text_col])
