"""Benchmark decontamination by winnowing, in DataFrame functions only.

A *window* is ``WINDOW`` consecutive words of a benchmark item; an item of
fewer words (but not none) is one window.  A document word inside any
occurrence of a window is hit.

*Winnowing.*  Each text's ``K``-word grams are hashed, and the smallest of the
``WINDOW - K + 1`` hashes in a window is its fingerprint.  Two equal windows have equal hashes
and so the same fingerprint: none can be missed.  Documents' fingerprints are joined with the
benchmark's and the match is *extended* in the same join: it holds only for windows whose words are all equal.

*Scale.*  Documents are read once and never shuffled whole.  Before anything
is exploded, fingerprints pass a bitmap of the benchmark's fingerprints (a
scalar subquery of ``BITMAP_WORDS`` longs, whatever the benchmark's size; a
full bitmap only passes more to the join).  What passes carries the ``WINDOW`` words.  The join is Spark's own choice.
The benchmark has one row per *different* window, with the items that hold it: a sentence that many items share (a prompt template)
and many documents quote is met once per place, however many items there are, and items that merely share a fingerprint
meet nothing.  Per document the matches are bounded by its length; a passage that a third of all documents
share is one match per document and place.

Items shorter than a window are looked up by the hash of all their words, for
just the lengths that occur.

Defined results: null texts and texts without words have no words and no
hits; empty items match nothing; an item without id hits but is not listed;
repeated documents and repeated items each stand for themselves; either table
may be empty; further input columns are not looked at.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bitmap, in_bitmap, spare_name, whole_text

WINDOW = 10
K = 5
#: 64-bit words of the bitmap that the benchmark's fingerprints are folded into.
BITMAP_WORDS = 1 << 14
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def bench_words(text: Column | str) -> Column:
    """A-Z lower-cased, then the runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]``."""
    lowered = F.translate(whole_text(text), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lowered, SEPARATORS), "")


def _gram_hashes(words: str, k: int) -> str:
    grams = ", ".join(f"{words}[i + {j}]" for j in range(k))
    return f"transform(sequence(0, size({words}) - {k}), i -> xxhash64({grams}))"


def _window_minima(hashes: str, width: int) -> str:
    neighbours = ", ".join(f"{hashes}[i + {j}]" for j in range(width))
    return f"transform(sequence(0, size({hashes}) - {width}), i -> least({neighbours}))"


def _windows(window: int, passes: str) -> str:
    """Structs (print, at, words) of the windows whose fingerprint ``passes``, from words and minima."""
    return (f"transform(filter(sequence(0, size(minima) - 1), i -> {passes.format('minima[i]')}), "
            f"i -> named_struct('print', minima[i], 'at', i, 'words', slice(words, i + 1, {window})))")


def benchmark_prints(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text",
                     window: int = WINDOW, k: int = K) -> DataFrame:
    """One row per different window of the benchmark: print (fingerprint), words, items (that hold it, as strings)."""
    items = (benchmark.select(F.col(item_col).cast("string").alias("item"), bench_words(text_col).alias("words"))
             .filter(F.size("words") > 0))
    long = (items.filter(F.size("words") >= window)
            .withColumn("hashes", F.expr(_gram_hashes("words", k)))
            .withColumn("minima", F.expr(_window_minima("hashes", window - k + 1)))
            .select("item", F.explode(F.expr(_windows(window, "true"))).alias("p"))
            .select("item", "p.print", "p.words"))
    short = (items.filter(F.size("words") < window)
             .select("item", F.xxhash64(F.size("words"), "words").alias("print"), "words"))
    return long.unionByName(short).groupBy("print", "words").agg(F.collect_set("item").alias("items"))


def hit_words(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, k: int = K,
              bitmap_words: int = BITMAP_WORDS) -> DataFrame:
    """A row per document: doc_id, n_words, n_hit, items (sorted as strings), contaminated."""
    width = window - k + 1
    prints = benchmark_prints(benchmark, item_col, item_text_col, window, k)
    cells = bitmap(prints.select(F.col("print").alias("hash")), bitmap_words).scalar()
    short_lengths = prints.filter(F.size("words") < window).agg(F.array_sort(F.collect_set(F.size("words")))).scalar()
    passes = in_bitmap("cells", "{0}", bitmap_words)
    empty = "cast(array() as array<bigint>)"
    read = (docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"),
                        bench_words(text_col).alias("words"))
            .withColumns({"cells": cells, "lengths": short_lengths})
            .withColumn("hashes", F.expr(f"if(size(words) >= {window}, {_gram_hashes('words', k)}, {empty})"))
            .withColumn("minima", F.expr(f"if(size(words) >= {window}, {_window_minima('hashes', width)}, {empty})")))
    long = f"if(size(minima) > 0, {_windows(window, passes)}, array())"
    short = (f"flatten(transform(filter(lengths, n -> n <= size(words)), n -> transform("
             f"filter(sequence(0, size(words) - n), i -> {in_bitmap('cells', 'xxhash64(n, slice(words, i + 1, n))', bitmap_words)}), "
             f"i -> named_struct('print', xxhash64(n, slice(words, i + 1, n)), 'at', i, 'words', slice(words, i + 1, n)))))")
    found = read.select("row", "doc_id", F.size("words").cast("long").alias("n_words"),
                        F.explode_outer(F.concat(F.expr(long), F.expr(short))).alias("p"))
    # texts without any window to look up are spread by their row: as nulls they would meet in one task
    found = found.select("row", "doc_id", "n_words", "p.at", F.coalesce("p.print", F.xxhash64("row")).alias("print"),
                         F.coalesce("p.words", F.array().cast("array<string>")).alias("words"))
    place = F.struct(F.col("at").alias("start"), F.size("words").alias("length"))
    matched = found.join(prints, ["print", "words"], "left").select(
        "row", "doc_id", "n_words", "items", F.when(F.col("items").isNotNull(), place).alias("window"))
    per_doc = matched.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.collect_set("window").alias("windows"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    covered = F.expr("size(array_distinct(flatten("
                     "transform(windows, w -> sequence(w.start, w.start + w.length - 1)))))")
    return per_doc.select("doc_id", "n_words", covered.cast("long").alias("n_hit"), "items",
                          (covered > 0).alias("contaminated"))


def clean_rows(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               **options) -> DataFrame:
    """``docs`` without the rows that hold a benchmark window; other rows stay, whatever id they share."""
    digest = F.unhex(F.sha2(whole_text(docs[text_col]), 256))
    id_name, digest_name = spare_name(docs, "contaminated_id"), spare_name(docs, "contaminated_digest")
    # Rows with one id and one text have one verdict.
    keyed = docs.select(F.struct(docs[id_col].alias("id"), digest.alias("digest")).alias("key"), docs[text_col])
    bad = hit_words(keyed, benchmark, "key", text_col, **options).filter("contaminated").select(
        F.col("doc_id.id").alias(id_name), F.col("doc_id.digest").alias(digest_name)).distinct()
    return docs.join(bad, docs[id_col].eqNullSafe(bad[id_name]) & (digest == bad[digest_name]), "left_anti")
