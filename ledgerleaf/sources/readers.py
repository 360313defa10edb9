"""Sources: declared schemas, required columns, text lines and columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# leading and trailing white space, Unicode blanks included
_EDGES = r"^[\s\p{Z}\x0B\x1c-\x1f\x85]+|[\s\p{Z}\x0B\x1c-\x1f\x85]+$"
_LINE_END = r"\r\n|\r|\n"

_TEXT_COLUMNS = ("transaction_id", "value_date", "posted_at", "amount", "currency", "dr_cr", "merchant_name",
                 "reference", "narrative", "channel", "account_type", "city", "keyword_hit", "category_id",
                 "category_display_name")
# delimited files hold text only; typed columns are made with try_* so that dirty cells turn null
RAW_TRANSACTION_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in _TEXT_COLUMNS])


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"column {missing[0]!r} not found; available: {df.columns}")
    return df


def require_csv(path: str) -> str:
    if not path.lower().rstrip("/").endswith(".csv"):
        raise ValueError(f"only .csv inputs are accepted, got {path!r}")
    return path


def csv_options(multi_line: bool) -> dict[str, str]:
    """What batch and stream readers share.

    Without ``multi_line`` a record is a line, and large files are split over tasks.  With it quoted cells may hold line
    breaks, and a file is one task: then write many files.
    """
    return {"header": "true", "multiLine": str(multi_line).lower(), "escape": '"', "ignoreLeadingWhiteSpace": "false",
            "nullValue": "", "emptyValue": ""}


def read_csv(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = False) -> DataFrame:
    """Delimited files with header."""
    return spark.read.schema(schema).options(**csv_options(multi_line)).csv(path)


def read_csv_stream(spark: SparkSession, folder: str, schema: T.StructType, multi_line: bool = False) -> DataFrame:
    """The same for files that arrive in a folder."""
    return spark.readStream.schema(schema).options(**csv_options(multi_line)).csv(folder)


def typed_transactions(raw: DataFrame) -> DataFrame:
    """Dates and amounts from text; unparsable cells become null."""
    return raw.withColumns({
        "value_date": F.try_to_date("value_date", "yyyy-MM-dd"),
        "posted_at": F.try_to_date("posted_at", "yyyy-MM-dd"),
        "amount": F.col("amount").try_cast("decimal(18,2)"),
    })


def read_transactions(spark: SparkSession, path: str) -> DataFrame:
    return typed_transactions(read_csv(spark, path, RAW_TRANSACTION_SCHEMA))


def non_blank(df: DataFrame, column: str) -> DataFrame:
    """One trimmed text column without blank or null values."""
    require_columns(df, column)
    trimmed = F.regexp_replace(F.coalesce(F.col(column), F.lit("")), _EDGES, "")
    return df.select(trimmed.alias("text")).where(F.col("text") != "")


def read_text_lines(spark: SparkSession, path: str) -> DataFrame:
    return non_blank(spark.read.text(path), "value")


def text_lines(df: DataFrame, column: str) -> DataFrame:
    """Lines inside a text column, trimmed, blank ones dropped; other columns stay."""
    rest = [c for c in df.columns if c != column]
    line = F.explode(F.split(F.col(column), _LINE_END)).alias("__line")
    trimmed = df.select(*rest, line).withColumn("line", F.regexp_replace("__line", _EDGES, ""))
    return trimmed.where(F.col("line") != "").drop("__line")


def texts(spark: SparkSession, values: list[str]) -> DataFrame:
    """A short list of literal texts with row ids."""
    if not values:
        raise ValueError("texts must not be empty")
    return spark.createDataFrame(list(enumerate(values)), "row_id long, text string")


def with_row_id(df: DataFrame, name: str = "row_id") -> DataFrame:
    """Row id for inputs without a key: position of the row in its file split."""
    return df.withColumn(name, F.monotonically_increasing_id())
