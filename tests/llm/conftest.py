import random
import string

import pytest
from pyspark.sql import types as T

DOC_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
    # names that operators use for columns of their own
    T.StructField("size", T.StringType()), T.StructField("score", T.StringType()),
    T.StructField("digest", T.StringType()), T.StructField("bucket", T.StringType()),
    T.StructField("shard", T.StringType()), T.StructField("mix", T.StringType()),
    T.StructField("statistics", T.StringType()), T.StructField("words", T.StringType()),
])


def doc_frame(spark, rows):
    """Rows of (doc_id, text[, source]) as a table with clashing further columns."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), *["x"] * 8) for r in rows]
    return spark.createDataFrame(full, DOC_SCHEMA).repartition(3)


def prose(rng, n_words, vocabulary=400):
    words = ["".join(rng.choice(string.ascii_lowercase) for _ in range(rng.randint(1, 8))) for _ in range(vocabulary)]
    return " ".join(rng.choice(words) for _ in range(n_words))


def awkward_rows():
    """Copies, near copies, shared passages, nulls, empties, blanks, ties, repeated rows and a very long text."""
    rng = random.Random(11)
    passage = prose(rng, 90)
    base = prose(rng, 200)
    edited = base.split(" ")
    edited[100] = "Überraschung"
    rows = [
        (5, base, "b"), (3, base, "a"), (9, " ".join(edited), "a"), (7, base + "\n", None),
        (1, prose(rng, 30) + "\t\t" + passage + "\x0b" + prose(rng, 25), "a"),
        (2, prose(rng, 8) + " \n" + passage + " " + prose(rng, 60), "b"),
        (4, passage.replace(" ", "  "), "c"), (6, "é" * 300 + passage[:450] + "ü" * 5, "d"),
        (10, None, "a"), (11, "", "b"), (12, " \n\t ", "c"), (13, "one", "a"), (14, "one", "e"), (15, "four words are here", "a"),
        (None, base, "a"), (None, None, None), (16, "tick tock " * 300, "a"), (17, "a" * 1500, "b"),
        (18, "x" * 399, "a"), (19, "x" * 399, "b"), (20, prose(rng, 6000), "z"), (21, passage + " " + passage, "a"),
        (22, " nbsp wide Σίσυφος İstanbul \U0001f600", "a"), (22, "same id, other text", "b"),
        (23, "repeated row " * 20, "a"), (23, "repeated row " * 20, "a"),
    ]
    for k in range(40):
        rows.append((100 + k, prose(rng, rng.randint(0, 120), 60), rng.choice("abcde")))
    return rows


@pytest.fixture(scope="session")
def awkward():
    return awkward_rows()


@pytest.fixture(scope="session")
def awkward_docs(spark, awkward):
    return doc_frame(spark, awkward).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC_SCHEMA)


def tuples(df, *columns):
    """All rows as sorted tuples, nulls first."""
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=lambda r: tuple((x is not None, x) for x in r))


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))
