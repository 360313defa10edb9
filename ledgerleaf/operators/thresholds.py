"""F1-tuned class thresholds from a histogram of probabilities."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerleaf import fixed_values as fv
from ledgerleaf.operators.labels import floor_of


def grid(rule: str = "v7") -> list[float]:
    """101 cut points; the newer rule keeps them in single precision."""
    points = np.linspace(fv.GRID_LOW, fv.GRID_HIGH, fv.GRID_POINTS)
    if rule == "v7":
        points = points.astype(np.float32)
    return [float(x) for x in points]


def _literal(points: list[float]) -> Column:
    return F.expr(f"array({', '.join(f'{x!r}D' for x in points)})")


def grid_bin(p: Column, points: list[float]) -> Column:
    """Number of grid points that are <= p: a guess by division, corrected by
    comparing with the two neighbouring points."""
    table = _literal(points)
    n = len(points)
    step = (points[-1] - points[0]) / (n - 1)
    guess = F.least(F.greatest(F.floor((p - points[0]) / step).cast("int") + 1, F.lit(0)), F.lit(n))
    point = lambda i: F.element_at(table, F.least(F.greatest(i, F.lit(1)), F.lit(n)))
    return (guess + F.when((guess < n) & (point(guess + 1) <= p), 1).otherwise(0)
            - F.when((guess >= 1) & (point(guess) > p), 1).otherwise(0))


def threshold_search(df: DataFrame, keys: list[str], y: str = "y", p: str = "p", rule: str = "v7") -> DataFrame:
    """Best one-vs-rest F1 cut per key; (keys, positives, n, best_f1, threshold).

    Rows shrink to at most 102 counts per key before any window.  F1 is constant
    between occupied bins, so the first grid point of each such stretch is enough
    to find the first best one.
    """
    points = grid(rule)
    table = _literal(points)
    counts = df.groupBy(*keys, grid_bin(F.col(p), points).alias("bin")).agg(
        F.sum(F.col(y).cast("long")).alias("pos"), F.count(F.lit(1)).alias("cnt"))
    down = W.partitionBy(*keys).orderBy(F.desc("bin"))
    whole = W.partitionBy(*keys)
    stretch = counts.select(
        *keys, "bin",
        F.sum("pos").over(down).alias("tp"), F.sum("cnt").over(down).alias("called"),
        F.sum("pos").over(whole).alias("positives"), F.sum("cnt").over(whole).alias("n"),
        (F.coalesce(F.lag("bin").over(whole.orderBy("bin")), F.lit(0)) + 1).alias("first_point"))
    tp, called, positives = (F.col(c).cast("double") for c in ("tp", "called", "positives"))
    if rule == "v7":
        precision = tp / F.greatest(called, F.lit(1e-12))
        recall = tp / F.greatest(positives, F.lit(1e-12))
        f1 = F.lit(2.0) * precision * recall / F.greatest(precision + recall, F.lit(1e-12))
    else:
        # 2TP / (2TP + FP + FN)
        f1 = F.lit(2.0) * tp / F.greatest(called + positives, F.lit(1e-12))
    scored = stretch.withColumn("f1", f1)
    # highest f1, then lowest grid point
    best = scored.groupBy(*keys).agg(
        F.first("positives").alias("positives"), F.first("n").alias("n"),
        F.max(F.when(F.col("bin") >= 1, F.struct(F.col("f1").alias("f1"), (-F.col("first_point")).alias("neg")))
              ).alias("best"))
    degenerate = (F.col("positives") == 0) | (F.col("positives") == F.col("n"))
    nothing = F.lit(points[0] if rule == "v7" else fv.DEGENERATE_THRESHOLD)
    f1_best = F.coalesce(F.col("best.f1"), F.lit(0.0))
    found = F.when(f1_best > 0, F.element_at(table, -F.col("best.neg"))).otherwise(nothing)
    return best.select(
        *keys, "positives", "n",
        F.when(degenerate, F.lit(0.0)).otherwise(f1_best).alias("best_f1"),
        F.when(degenerate, F.lit(fv.DEGENERATE_THRESHOLD)).otherwise(found).alias("threshold"))


def apply_floors(thresholds: DataFrame, cls: str, floors: dict) -> DataFrame:
    """Raise thresholds to the floor of their class where one is set."""
    # greatest() skips nulls, so classes without a floor keep their threshold
    return thresholds.withColumn("threshold", F.greatest(F.col("threshold"), floor_of(F.col(cls), floors, None)))


def apply_thresholds(df: DataFrame, cls: str, p: str, thresholds: DataFrame,
                     default: float = fv.DEFAULT_THRESHOLD) -> DataFrame:
    """Add the class threshold (default where missing) and whether ``p`` reaches it."""
    side = thresholds.select(F.col("cls").alias(cls), F.col("threshold").alias("__thr"))
    return df.join(side, cls, "left").withColumn(
        "threshold", F.coalesce("__thr", F.lit(default))).drop("__thr").withColumn(
        "reached", F.col(p) >= F.col("threshold"))
