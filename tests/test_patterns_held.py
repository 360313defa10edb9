"""Patterns whose fragments a task holds against patterns that are joined, and what a run of the join computes."""

import random

from pyspark.sql import functions as F

from ledgerleaf.operators import patterns as pt


def _rows(df):
    return sorted(map(tuple, df.collect()))


def test_held_fragments_equal_joined_ones(spark, monkeypatch):
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdé😀日") for _ in range(rng.randrange(1, 6))) for _ in range(60)]
    texts = [(i % 90, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 9))).upper()) for i in range(120)]
    texts += [(None, "ABC abc"), (7, None), (8, ""), (9, "ab"), (10, "abc"), (10, "ABC  é😀日")]
    rows = spark.createDataFrame(texts, "row_id long, text string").repartition(4)
    table = [(w, len(w)) for w in words] + [(f"{a}|{b}", 0) for a, b in zip(words, words[7:])] + [("abc", 1), ("abc", 2), (None, 3), ("[a-c]b", 4)]
    patterns = spark.createDataFrame(table, "pattern string, weight int")
    joined = pt.pattern_join(rows, patterns, most=0)
    expected = sorted(map(str, _rows(joined.select(*(F.col(c).cast("string") for c in joined.columns)).fillna("none"))))
    for own in (pt.OWN_TESTS, 0):  # expressions of their own, and patterns as a column
        monkeypatch.setattr(pt, "OWN_TESTS", own)
        held = pt.pattern_join(rows, patterns)
        assert sorted(map(str, _rows(held.select(*(F.col(c).cast("string") for c in joined.columns)).fillna("none")))) == expected
    assert len(expected) > 300


def test_patterns_are_drawn_once(spark):
    drawn = spark.sparkContext.accumulator(0)

    def seen(rows):
        for r in rows:
            drawn.add(1)
            yield r

    patterns = spark.createDataFrame(spark.sparkContext.parallelize([("abc",), ("bcd|x",)], 1).mapPartitions(seen), "pattern string")
    texts = spark.createDataFrame([(1, "zabcz"), (2, "BCD"), (3, "y")], "row_id long, text string")
    assert {(r.row_id, r.pattern) for r in pt.pattern_join(texts, patterns).collect()} == {(1, "abc"), (2, "bcd|x")}
    assert drawn.value == 2
