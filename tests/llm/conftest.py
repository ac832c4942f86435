"""Small tables with every oddity the operators must stand, shared by their tests."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ("score", "n_words", "kept", "class_id", "rank", "size", "taken", "leaf", "root", "key", "number", "id", "weight")


@pytest.fixture(scope="session")
def odd_rows():
    r = random.Random(4)
    vocabulary = [f"w{i}" for i in range(300)]
    passage = " ".join(r.choice(vocabulary) for _ in range(60))
    rows = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randint(5, 80))), r.choice(["en", "de", None]), r.choice(["s0", "s1", None]), 1) for i in range(30)]
    rows += [(30, None, None, None, None), (31, "", "en", "s0", 0), (32, " \n\t", "en", "s0", 3), (None, passage, "en", "s0", 9), (33, passage + " tail one", "en", "s1", 9), (34, "start two " + passage, "en", "s0", 9)]
    rows += [(35, rows[3][1], "en", "s0", 1), (36, rows[3][1] + " More É", "Ünï", "s0", 1), rows[5], rows[5], (37, "long " * 3000 + "x" * 40000, "en", "s0", 1), (38, "word", "en", "s0", 1), (39, "word", "en", "s0", 1)]
    return rows


def _table(spark, rows):
    df = spark.createDataFrame(rows, DOCS)
    for c in CLASHES:
        df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.fixture(scope="session")
def tables(spark, odd_rows):
    """The odd table, and tables of one oddity each."""
    short = [(i, "only a few words here", "en", "s0", 1) for i in range(5)]
    mixed = spark.createDataFrame(short, DOCS).coalesce(1).union(spark.createDataFrame(odd_rows[:12], DOCS).coalesce(1))  # a partition of short texts only
    for c in CLASHES:
        mixed = mixed.withColumn(c, F.lit("clash"))
    return {
        "odd": _table(spark, odd_rows),
        "empty": _table(spark, []),
        "one short": _table(spark, [(1, "three short words", "en", "s0", 1)]),
        "only nulls": _table(spark, [(None, None, None, None, None)] * 3 + [(1, None, None, None, None)]),
        "no words": _table(spark, [(1, "", "en", "s0", 1), (2, " \n", "en", "s0", 1)]),
        "repeated": _table(spark, [(1, odd_rows[0][1], "en", "s0", 1)] * 40 + [(2, odd_rows[1][1], "de", "s1", 1)] * 3),
        "short partition": mixed,
    }
