"""Batch jobs for spark-submit.

    python -m ledgerleaf.plans.jobs train    --input train.csv --model M
    python -m ledgerleaf.plans.jobs evaluate --input train.csv --test test.csv --model M --output reports
    python -m ledgerleaf.plans.jobs score    --input in.csv --model M --output out --text narrative
    python -m ledgerleaf.plans.jobs predict  --model M --output out (--text-value "..." | --lines file | --input in.csv --text column)

Inputs that end in .csv are delimited files with a header, others Parquet folders.
"""

from __future__ import annotations

import argparse
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerleaf.config import CategorizerConfig
from ledgerleaf.operators import labels as lb
from ledgerleaf.operators import reports as rp
from ledgerleaf.plans.categorizer import Categorizer, CategorizerModel
from ledgerleaf.plans.storage import new_path
from ledgerleaf.sources import readers, writers


def _header_schema(spark: SparkSession, path: str) -> T.StructType:
    """All columns of the header, as text."""
    names = spark.read.option("header", True).csv(path).columns
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def read_table(spark: SparkSession, source: str, multi_line: bool = False) -> DataFrame:
    if source.lower().rstrip("/").endswith(".csv"):
        return readers.read_csv(spark, source, _header_schema(spark, source), multi_line)
    return spark.read.parquet(source)


def _labelled(spark: SparkSession, source: str, multi_line: bool) -> DataFrame:
    """Text and label, with a row id that is stored so that no later step can assign it differently."""
    rows = lb.labelled_view(read_table(spark, source, multi_line)).where(F.col("label").isNotNull())
    path = new_path(spark, "rows")
    readers.with_row_id(rows.select("raw_text", "label"), "__row_id").write.parquet(path)
    return spark.read.parquet(path)


def score(spark: SparkSession, model_path: str, source: str, output: str, text: str, low_conf: float = 0.60,
          multi_line: bool = False) -> None:
    """Score a CSV or Parquet input and write its columns and five more; one pass, no shuffle."""
    raw = readers.require_columns(read_table(spark, source, multi_line), text)
    scored = CategorizerModel.load(spark, model_path).transform(raw, text=text, low_conf=low_conf)
    writers.write_csv(writers.scored_output(scored, raw.columns), output)


def train(spark: SparkSession, source: str, model_path: str, cfg: CategorizerConfig | None = None,
          multi_line: bool = False) -> CategorizerModel:
    rows = _labelled(spark, source, multi_line)
    model = Categorizer(cfg).fit(rows, text="raw_text", label="label", row_id="__row_id")
    model.save(model_path)
    return model


def evaluate(spark: SparkSession, train_source: str, test_source: str, model_path: str, output: str,
             cfg: CategorizerConfig | None = None, *, explain: bool = True, review: bool = True,
             multi_line: bool = False) -> dict:
    """Fit on one table, score another, and write below ``output``:

    ``preds_test`` (test columns, pred, pred_proba, explain), ``review`` (rows of low confidence, if any), ``report``,
    ``confusion_matrix`` (labels on both axes) and ``metrics`` (six fields), which are also returned.
    """
    cfg = cfg or CategorizerConfig()
    rows = _labelled(spark, train_source, multi_line)
    model = Categorizer(cfg).fit(rows, text="raw_text", label="label", row_id="__row_id")
    model.save(model_path)
    test = lb.labelled_view(read_table(spark, test_source, multi_line)).withColumnRenamed("label", "__truth")
    start = time.perf_counter()
    path = new_path(spark, "evaluated")
    model.transform(test, text="raw_text", explain=explain).write.parquet(path)
    seconds = time.perf_counter() - start
    scored = spark.read.parquet(path)
    writers.write_csv(writers.predictions(scored, test.columns, "__truth"), f"{output}/preds_test")
    if review:
        writers.write_review_queue(rp.review_queue(scored, "__truth", "raw_text", cfg.low_conf), f"{output}/review")
    writers.write_csv(rp.classification_report(scored, "__truth", "label", digits=3), f"{output}/report")
    writers.write_csv(rp.confusion_wide(scored, "__truth", "label"), f"{output}/confusion_matrix")
    metrics = rp.metrics_summary(scored, rows, "__truth", "label", seconds)
    metrics.coalesce(1).write.json(f"{output}/metrics")
    return spark.read.json(f"{output}/metrics").first().asDict()


def predict(spark: SparkSession, model_path: str, output: str, *, texts: list[str] | None = None, lines: str | None = None,
            source: str | None = None, column: str | None = None, low_conf: float = 0.60, display: bool = False,
            multi_line: bool = False) -> None:
    """Predictions with explanations for literal texts, the lines of a text file, or one column of a table.

    Written as JSON lines, or as the shortened table for display.
    """
    given = [x is not None for x in (texts, lines, source)]
    if sum(given) != 1:
        raise ValueError("give exactly one of texts, lines and source")
    if texts is not None:
        rows = readers.texts(spark, texts)
    elif lines is not None:
        rows = readers.read_text_lines(spark, lines)
    else:
        rows = readers.non_blank(read_table(spark, source, multi_line), column or "narrative")
    scored = CategorizerModel.load(spark, model_path).transform(rows.select("text"), low_conf=low_conf, explain=True)
    if display:
        writers.write_csv(writers.display_projection(scored), output)
    else:
        writers.predictions_json(scored).write.text(output)


def _config(args: argparse.Namespace) -> CategorizerConfig:
    """The knobs that the command line names; others keep their defaults."""
    names = ("word_max_features", "char_max_features", "word_min_df", "char_min_df", "coarse_trainer", "fine_trainer",
             "max_iter", "coarse_cal_size", "fine_cal_size", "threshold_rule", "calibrate_on", "low_conf")
    return CategorizerConfig(**{n: getattr(args, n) for n in names if getattr(args, n) is not None})


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("job", choices=["score", "train", "evaluate", "predict"])
    parser.add_argument("--model", required=True)
    for name in ("--input", "--test", "--output", "--lines"):
        parser.add_argument(name)
    parser.add_argument("--text", default="narrative")
    parser.add_argument("--text-value", action="append")
    for name in ("word-max-features", "char-max-features", "word-min-df", "char-min-df", "max-iter", "coarse-cal-size", "fine-cal-size"):
        parser.add_argument(f"--{name}", type=int)
    for name, choices in (("coarse-trainer", ("lr", "ovr", "nb")), ("fine-trainer", ("ensemble", "nb")),
                          ("threshold-rule", ("v7", "v6")), ("calibrate-on", ("train", "holdout"))):
        parser.add_argument(f"--{name}", choices=choices)
    parser.add_argument("--low-conf", type=float)
    for name in ("no-explain", "no-review", "display", "multi-line"):
        parser.add_argument(f"--{name}", action="store_true")
    args = parser.parse_args()
    spark = SparkSession.builder.appName("ledgerleaf").getOrCreate()
    low = 0.60 if args.low_conf is None else args.low_conf
    if args.job == "score":
        score(spark, args.model, args.input, args.output, args.text, low, args.multi_line)
    elif args.job == "train":
        train(spark, args.input, args.model, _config(args), args.multi_line)
    elif args.job == "evaluate":
        evaluate(spark, args.input, args.test, args.model, args.output, _config(args), explain=not args.no_explain,
                 review=not args.no_review, multi_line=args.multi_line)
    else:
        predict(spark, args.model, args.output, texts=args.text_value, lines=args.lines, source=args.input, column=args.text,
                low_conf=low, display=args.display, multi_line=args.multi_line)


if __name__ == "__main__":
    main()
