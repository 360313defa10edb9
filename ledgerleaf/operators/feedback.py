"""Reviewer feedback: the last decision per prediction, and what it says."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerleaf import fixed_values as fv

NOT_REVIEWED = "Not reviewed"


def feedback_latest(feedback: DataFrame, key: str = "row_id", ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """Latest decision per key.

    An aggregation, not a window: a key with very many clicks is reduced to
    one row per map task before the shuffle.
    """
    values = [c for c in feedback.columns if c != key]
    newest = F.max_by(F.struct(*values), F.struct(ts, tie))
    return feedback.groupBy(key).agg(newest.alias("v")).select(key, "v.*")


def feedback_join(predictions: DataFrame, feedback: DataFrame, key: str = "row_id") -> DataFrame:
    """Predictions with their last decision; both sides have one row per key."""
    latest = feedback_latest(feedback, key).select(key, "status", "corrected_label")
    corrected = F.coalesce(F.nullif(F.trim("corrected_label"), F.lit("")), F.lit(fv.FALLBACK_LABEL))
    joined = predictions.join(latest, key, "left")
    final = F.when(F.col("status") == "Corrected", corrected).otherwise(F.col("label"))
    return joined.withColumn("status", F.coalesce("status", F.lit(NOT_REVIEWED))).withColumn("final_label", final) \
        .drop("corrected_label")


def feedback_accuracy(joined: DataFrame) -> DataFrame:
    """Accepted, corrected and unreviewed rows per predicted label."""
    n = lambda s: F.sum(F.when(F.col("status") == s, 1).otherwise(0))
    counts = joined.groupBy("label").agg(
        F.count(F.lit(1)).alias("total_rows"), n("Accepted").alias("accepted"), n("Corrected").alias("corrected"),
        n(NOT_REVIEWED).alias("not_reviewed"))
    reviewed = F.col("accepted") + F.col("corrected")
    return counts.withColumn("accepted_share", F.when(reviewed > 0, F.round(F.col("accepted") / reviewed, 6)))
