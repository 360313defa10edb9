"""Sinks: one logical write per result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerleaf.functions import text as tx
from ledgerleaf.plans.categorizer import OUTPUT_COLUMNS


def scored_output(scored: DataFrame, input_columns: list[str]) -> DataFrame:
    """Input columns followed by the five prediction columns."""
    return scored.select(*[c for c in input_columns if c not in OUTPUT_COLUMNS], *OUTPUT_COLUMNS)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).option("escape", '"').option("emptyValue", "") \
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_review_queue(queue: DataFrame, path: str) -> bool:
    """Write the queue; nothing is written when it is empty."""
    if queue.isEmpty():
        return False
    write_csv(queue, path)
    return True


def predictions(scored: DataFrame, input_columns: list[str], truth: str) -> DataFrame:
    """Input columns with the truth as ``label``, then pred, pred_proba and explain (empty where there is none)."""
    explain = F.coalesce("explanation", F.lit("")) if "explanation" in scored.columns else F.lit("")
    inputs = [F.col(c) for c in input_columns if c not in (truth, *OUTPUT_COLUMNS, "explanation")]
    return scored.select(*inputs, F.col(truth).alias("label"), F.col("label").alias("pred"),
                         F.col("confidence").alias("pred_proba"), explain.alias("explain"))


def _id(scored: DataFrame) -> list[str]:
    return [c for c in ("row_id",) if c in scored.columns]


def prediction_record(text: str = "text") -> list:
    """Columns of one prediction; an empty explanation reads as null."""
    return [F.col(text).alias("text"), F.col("label"), F.col("confidence"), F.col("coarse_label"),
            F.col("coarse_confidence"), F.col("needs_review"), F.nullif("explanation", F.lit("")).alias("explanation")]


def predictions_json(scored: DataFrame, text: str = "text") -> DataFrame:
    """One JSON document per row, non-ASCII characters escaped as \\uXXXX."""
    doc = F.to_json(F.struct(*prediction_record(text)), {"ignoreNullFields": "false", "writeNonAsciiCharacterAsCodePoint": "true"})
    return scored.select(*_id(scored), doc.alias("json"))


def display_projection(scored: DataFrame, text: str = "text", limit: int = 96) -> DataFrame:
    """Printable columns: shortened text, three decimals."""
    return scored.select(
        *_id(scored), tx.shorten(F.coalesce(F.col(text), F.lit("")), limit).alias("text"), "label",
        tx.fixed_decimals(F.col("confidence"), 3).alias("conf"),
        F.when(F.col("needs_review"), "True").otherwise("False").alias("needs_review"),
        F.col("coarse_label").alias("coarse"), tx.fixed_decimals(F.col("coarse_confidence"), 3).alias("coarse_conf"))
