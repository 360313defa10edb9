"""Data-quality rules over transaction rows.

Row rules are booleans in one projection; only the duplicate rule needs a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerleaf import fixed_values as fv
from ledgerleaf.operators.joins import few, range_join, with_copies

ANY_LABEL, BANDS = "*", ("under", "lower", "upper", "over")
OPTIONAL_FIELDS = ("merchant_name", "city", "reference", "keyword_hit")


def _map(values: dict, make) -> Column:
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), make(v))])


def date_rules(df: DataFrame) -> DataFrame:
    gap = F.datediff("posted_at", "value_date")
    return df.withColumns({"post_gap_days": gap, "posted_early": gap < 0, "posted_late": gap >= fv.POSTING_LATE_DAYS})


def amount_rules(df: DataFrame, label: str = "category_id", limits: dict | None = None) -> DataFrame:
    """Compare the amount with the range of its label."""
    table = _map(limits or fv.AMOUNTS, lambda lh: F.struct(F.lit(lh[0]).alias("low"), F.lit(lh[1]).alias("high")))
    found = F.try_element_at(table, F.col(label))
    out = df.withColumns({"low": F.coalesce(found["low"], F.lit(fv.AMOUNT_DEFAULT[0])),
                          "high": F.coalesce(found["high"], F.lit(fv.AMOUNT_DEFAULT[1]))})
    a = F.col("amount")
    return out.withColumns({"out_of_range": (a < F.col("low")) | (a > F.col("high")),
                            "tiny": a <= fv.TINY_AMOUNT})


def channel_rules(df: DataFrame, label: str = "category_id") -> DataFrame:
    words = lambda v: F.array(*[F.lit(c) for c in v])
    expected = F.coalesce(F.try_element_at(_map(fv.CHANNELS, words), F.col(label)), words(fv.CHANNELS_DEFAULT))
    return df.withColumn("odd_channel", ~F.array_contains(expected, F.col("channel")))


def is_blank(name: str) -> Column:
    return F.trim(F.coalesce(F.col(name), F.lit(""))) == ""


def missing_rules(df: DataFrame) -> DataFrame:
    return df.withColumns({f"missing_{c}": is_blank(c) for c in OPTIONAL_FIELDS})


def currency_rules(df: DataFrame) -> DataFrame:
    return df.withColumn("foreign_currency", F.col("currency") != fv.HOME_CURRENCY)


def label_name_rules(df: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """The label's display name differs from the one on the row."""
    names = taxonomy.select(F.col("id").alias("category_id"), F.col("display_name").alias("expected_name"))
    return df.join(names, "category_id", "left").withColumn(
        "name_mismatch", F.coalesce(F.col("expected_name") != F.col("category_display_name"), F.lit(True)))


def direction_rules(df: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Credit rows outside the income group, debit rows inside, refunds labelled as something else."""
    groups = taxonomy.select(F.col("id").alias("category_id"), F.col("group").alias("label_group"))
    out = df.join(groups, "category_id", "left")
    credit = F.col("dr_cr") == "CR"
    refund = credit & F.upper(F.coalesce("narrative", F.lit(""))).startswith(fv.REFUND_PREFIX)
    return out.withColumns({
        "direction_mismatch": credit != F.coalesce(F.col("label_group") == "INCOME", F.lit(False)),
        "unlabelled_refund": refund & (F.col("category_id") != fv.REFUND_LABEL)})


def duplicate_rules(df: DataFrame, key: str = "transaction_id", row_id: str = "row_id") -> DataFrame:
    """Add ``copies`` and ``duplicate``."""
    return with_copies(df, key, spread_by=row_id).withColumn("duplicate", F.col("copies") > 1)


def limit_bands(spark: SparkSession, limits: dict | None = None, default: tuple = fv.AMOUNT_DEFAULT) -> DataFrame:
    """(label, band, low, high): the amounts of a label below, in both halves of, and above its range; ``ANY_LABEL`` for all others."""
    rows = []
    for label, (low, high) in {**(limits or fv.AMOUNTS), ANY_LABEL: default}.items():
        cuts = [None, low, (low + high) // 2, high, None]
        rows += [(label, band, a, b) for band, a, b in zip(BANDS, cuts, cuts[1:], strict=False)]
    return spark.createDataFrame(rows, "label string, band string, low long, high long")


def amount_bands(df: DataFrame, bands: DataFrame, label: str = "category_id", amount: str = "amount") -> DataFrame:
    """Add ``band``, ``low`` and ``high`` from a table of limits: the band of the row's label (of ``ANY_LABEL`` if the table
    does not name it) that holds its amount, low end included.  Null amounts have none."""
    named = bands.select(F.col("label").alias("__known")).distinct()
    named = F.broadcast(named) if few(named) else named
    rows = df.join(named, F.col(label) == F.col("__known"), "left").withColumn("label", F.coalesce("__known", F.lit(ANY_LABEL)))
    return range_join(rows, bands, amount, "low", "high", ["label"]).drop("label", "__known")


RULES = ("posted_early", "posted_late", "out_of_range", "tiny", "odd_channel",
         *[f"missing_{c}" for c in OPTIONAL_FIELDS], "foreign_currency", "name_mismatch", "direction_mismatch",
         "unlabelled_refund", "duplicate")


def check(df: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """All rules: input columns plus ``rules``, the names of those that fired."""
    # null dates or amounts make a comparison null, which counts as not fired
    checked = duplicate_rules(df)
    for step in (date_rules, amount_rules, channel_rules, missing_rules, currency_rules):
        checked = step(checked)
    checked = direction_rules(label_name_rules(checked, taxonomy), taxonomy)
    fired = F.array_compact(F.array(*[F.when(F.col(r), F.lit(r)) for r in RULES]))
    return checked.withColumn("rules", fired).select(*df.columns, "rules")


def summary(checked: DataFrame) -> DataFrame:
    """Rows per rule; rules that never fired are absent."""
    return checked.select(F.explode("rules").alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("total_rows"))
