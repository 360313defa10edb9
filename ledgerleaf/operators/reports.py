"""Evaluation and batch reports.

Each report first reduces the rows to counts per (truth, prediction): at most
labels squared rows leave the partial aggregation, whatever the label skew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion_long(df: DataFrame, truth: str, pred: str, by: tuple = ()) -> DataFrame:
    return df.groupBy(*by, F.col(truth).alias("truth"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def confusion_wide(df: DataFrame, truth: str, pred: str, labels: list[str] | None = None, max_labels: int = 1_000) -> DataFrame:
    """One row and one count column per label of either side, and per label of ``labels``; more than ``max_labels`` are an error."""
    sides = df.select(F.explode(F.array(truth, pred)).alias("label")).where("label is not null").distinct()
    found = sides.limit(max_labels + 1).collect()
    if len(found) > max_labels:
        raise ValueError(f"more than {max_labels} distinct labels; are the columns right?")
    labels = sorted({*(labels or []), *(r["label"] for r in found)})
    wide = confusion_long(df, truth, pred).groupBy("truth").pivot("pred", labels).agg(F.sum("n"))
    axis = df.sparkSession.createDataFrame([(x,) for x in labels], "truth string")
    filled = [F.coalesce(F.col(f"`{x}`"), F.lit(0)).alias(x) for x in labels]
    return axis.join(wide, "truth", "left").select("truth", *filled).orderBy("truth")


def per_class(counts: DataFrame, by: tuple = ()) -> DataFrame:
    """Precision, recall, F1 and support per label of the union of both sides."""
    n = F.col("n")
    sides = counts.select(*by, F.inline(F.array(
        F.struct(F.col("truth").alias("label"), n.alias("support"), F.lit(0).cast("long").alias("predicted"),
                 F.when(F.col("truth") == F.col("pred"), n).otherwise(0).alias("tp")),
        F.struct(F.col("pred").alias("label"), F.lit(0).cast("long").alias("support"), n.alias("predicted"),
                 F.lit(0).cast("long").alias("tp")))))
    sums = sides.groupBy(*by, "label").agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "tp")])
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    out = sums.withColumn("precision", ratio(F.col("tp"), F.col("predicted"))) \
        .withColumn("recall", ratio(F.col("tp"), F.col("support")))
    pr, re = F.col("precision"), F.col("recall")
    return out.withColumn("f1", ratio(F.lit(2.0) * pr * re, pr + re))


def classification_report(df: DataFrame, truth: str, pred: str, by: tuple = (), digits: int = 6) -> DataFrame:
    """Per-class rows, then accuracy, macro average and weighted average."""
    counts = confusion_long(df, truth, pred, by)
    classes = per_class(counts, by)
    measures = ("precision", "recall", "f1")
    plain = [F.round(m, digits).alias(m) for m in measures]
    rows = classes.select(*by, F.lit("class").alias("kind"), "label", *plain, "support")
    macro = classes.groupBy(*by).agg(*[F.round(F.avg(m), digits).alias(m) for m in measures], F.sum("support").alias("support"))
    weighted = classes.groupBy(*by).agg(
        *[F.round(F.sum(F.col(m) * F.col("support")) / F.sum("support"), digits).alias(m) for m in measures],
        F.sum("support").alias("support"))
    accuracy = classes.groupBy(*by).agg(
        *[F.round(F.sum("tp") / F.sum("support"), digits).alias(m) for m in measures], F.sum("support").alias("support"))
    for name, part in (("accuracy", accuracy), ("macro avg", macro), ("weighted avg", weighted)):
        rows = rows.unionByName(part.select(
            *by, F.lit("total").alias("kind"), F.lit(name).alias("label"), *measures, "support"))
    return rows


def accuracy_macro_f1(df: DataFrame, truth: str, pred: str, by: tuple = (), digits: int = 6) -> DataFrame:
    classes = per_class(confusion_long(df, truth, pred, by), by)
    return classes.groupBy(*by).agg(
        F.sum("support").alias("n"), F.round(F.sum("tp") / F.sum("support"), digits).alias("accuracy"),
        F.round(F.avg("f1"), digits).alias("macro_f1"))


def metrics_summary(scored: DataFrame, train: DataFrame, truth: str, pred: str,
                    seconds: float | None = None) -> DataFrame:
    """The one-row metrics record; timings only when the caller measured them."""
    n_train = train.agg(F.count(F.lit(1)).alias("n")).scalar()
    row = accuracy_macro_f1(scored, truth, pred, digits=3).select(
        "macro_f1", "accuracy", n_train.alias("n_train"), F.col("n").alias("n_test"))
    if seconds is None:
        return row
    return row.withColumn("throughput_tx_per_s", F.col("n_test") / F.lit(max(seconds, 1e-6))) \
        .withColumn("latency_ms_per_tx", F.lit(1000.0 * seconds) / F.col("n_test"))


def flagged_pct(df: DataFrame, by: tuple = ()) -> DataFrame:
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_rows"), F.sum(F.col("needs_review").cast("int")).alias("flagged"),
        F.round(F.avg(F.col("needs_review").cast("int")) * 100, 6).alias("flagged_pct"))


def batch_summary(df: DataFrame) -> DataFrame:
    """Rows and flagged rows per (coarse, label), per coarse and overall."""
    return df.rollup("coarse_label", "label").agg(
        F.count(F.lit(1)).alias("total_rows"), F.sum(F.col("needs_review").cast("int")).alias("flagged"),
        F.grouping_id().alias("level"))


def override_impact(df: DataFrame, truth: str) -> DataFrame:
    """What the override rules changed, and whether that helped."""
    right = lambda c: F.sum(F.when(F.col(c) == F.col(truth), 1).otherwise(0))
    return df.groupBy(F.coalesce("rule", F.lit("none")).alias("rule"), "label_raw", "label").agg(
        F.count(F.lit(1)).alias("total_rows"), right("label_raw").alias("right_before"), right("label").alias("right_after"))


def review_queue(df: DataFrame, truth: str, text: str, low_conf: float = 0.60) -> DataFrame:
    """Rows whose label confidence is low, as five columns.

    This tests the label confidence of every row; ``needs_review`` tests the
    coarse confidence where a bucket has no fitted model.
    """
    explain = F.col("explanation") if "explanation" in df.columns else F.lit("")
    return df.where(F.col("confidence") < low_conf).select(
        F.col(text).alias("raw_text"), F.col(truth).alias("label"), F.col("label").alias("pred"),
        F.col("confidence").alias("pred_proba"), F.coalesce(explain, F.lit("")).alias("explain"))
