"""Labelled statement lines derived from ``orders`` and ``customer``.

The driver tables hold no bank statements, so each order becomes one line by
deterministic expressions.  Rows k with k mod <prime> == r carry a known defect
so that the quality rules have something to find.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerleaf import fixed_values as fv
from ledgerleaf.functions import text as tx

LABELS = [
    "DINING", "GROCERIES", "FUEL", "MOBILITY", "TRAVEL", "HEALTH", "SHOPPING_ECOM", "SHOPPING_ELECTRONICS",
    "ENTERTAINMENT", "UTILITIES_POWER", "UTILITIES_TELECOM", "UTILITIES_WATER_GAS", "FEES", "OTHER",
    "INCOME_REFUNDS", "TRANSFER_SELF_INTERNAL",
]
CHANNEL_CYCLE = ["UPI", "CARD", "POS", "NETBANKING", "NEFT", "AUTOPAY"]
MERCHANTS = {
    "DINING": ["Zomato", "Swiggy", "Corner Cafe", "Spice Garden"],
    "GROCERIES": ["BigBasket", "DMart", "Fresh Lane", "Daily Basket"],
    "FUEL": ["HPCL Station", "Indian Oil", "Highway Pump", "City Fuels"],
    "MOBILITY": ["Uber India", "Rapido", "Metro Card", "Ola"],
    "TRAVEL": ["IRCTC", "IndiGo", "Blue Sky Tours", "Night Bus Co"],
    "HEALTH": ["Apollo", "1mg", "Care Clinic", "Smile Dental"],
    "SHOPPING_ECOM": ["Amazon", "Ajio", "Style Street", "Home Bazaar"],
    "SHOPPING_ELECTRONICS": ["Croma", "Vijay Sales", "Gadget Point", "Volt House"],
    "ENTERTAINMENT": ["Cine World", "Star Arena", "Game Den", "Stream Box"],
    "UTILITIES_POWER": ["State Power", "Tata Power", "North Grid", "City Electric"],
    "UTILITIES_TELECOM": ["Jio", "Airtel", "Fiber One", "Net Link"],
    "UTILITIES_WATER_GAS": ["Water Board", "Piped Gas", "City Gas", "Aqua Supply"],
    "FEES": ["Late Fee", "Annual Charge", "Card Fee", "Service Charge"],
    "OTHER": ["Misc Store", "General Counter", "Unknown Shop", "Local Vendor"],
    "INCOME_REFUNDS": ["Amazon Refund", "Order Return", "Cashback Desk", "Claim Refund"],
    "TRANSFER_SELF_INTERNAL": ["Own Account", "Amazon Pay", "Self Transfer", "Savings Sweep"],
}
KEYWORDS = {
    "DINING": ["dinner", "lunch", "takeaway"], "GROCERIES": ["vegetables", "grocery", "milk"],
    "FUEL": ["petrol", "diesel", "fuel"], "MOBILITY": ["ride", "cab", "metro"],
    "TRAVEL": ["flight", "train", "hotel"], "HEALTH": ["pharmacy", "clinic", "medicine"],
    "SHOPPING_ECOM": ["order", "fashion", "marketplace"], "SHOPPING_ELECTRONICS": ["laptop", "phone", "charger"],
    "ENTERTAINMENT": ["movie", "concert", "game"], "UTILITIES_POWER": ["electricity", "power", "meter"],
    "UTILITIES_TELECOM": ["recharge", "postpaid", "broadband"],
    "UTILITIES_WATER_GAS": ["water", "gas", "cylinder"], "FEES": ["fee", "penalty", "charges"],
    "OTHER": ["misc", "sundry", "other"], "INCOME_REFUNDS": ["refund", "returned", "cashback"],
    "TRANSFER_SELF_INTERNAL": ["self", "own", "sweep"],
}

#: What else a line may name: a handle, a bank or a network, and a place (some are stop words, some are not).
HANDLES = ["@home", "@shop", "@desk"]
PAYERS = [x for three in zip(HANDLES, fv.BANK_CODES, fv.CARD_NETWORKS) for x in three]
PLACES = ["Indore", "Pune", "Surat", "Agra", "Delhi", "Patna", "Nagpur"]
ACCOUNTS = ["BASIC", "PLUS", "JOINT"]
#: Every line is one of these orders of its parts.
LAYOUTS = [("channel", "spelled", "keyword_hit", "payer", "reference"), ("reference", "payer", "city", "spelled", "keyword_hit"),
           ("spelled", "city", "keyword_hit", "channel", "payer", "reference")]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash a file scan over more tasks when it comes in few pieces.

    One large row group would otherwise be expanded to n-grams by one task.  A
    scan that already has enough splits is left alone, without a shuffle.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n, key)


def _pick(values, index: Column) -> Column:
    """Element of a short literal list by zero-based index."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _pick_column(columns: list[Column], index: Column) -> Column:
    return F.element_at(F.array(*columns), (index + 1).cast("int"))


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One labelled statement line per order."""
    orders = spread(load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice"),
                    "o_orderkey")
    customer = load(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    k = F.col("row_id")
    kind, cycle = k % 16, F.floor(k / 16)

    base = orders.join(customer, orders.o_custkey == customer.c_custkey).select(
        F.col("o_orderkey").alias("row_id"),
        F.to_date("o_orderdate").alias("value_date"),
        F.round("o_totalprice", 2).cast("decimal(18,2)").alias("price"),
        F.col("c_nationkey").alias("nation"),
    )
    facts = base.select(
        "row_id", "value_date", "price",
        F.concat(F.lit("TX"), F.lpad(F.when(k % 67 == 1, k - 1).otherwise(k).cast("string"), 10, "0"))
        .alias("transaction_id"),
        _pick(LABELS, kind).alias("true_label"),
        _pick(LABELS, F.when(k % 29 == 0, (kind + 1) % 16).otherwise(kind)).alias("category_id"),
        _pick([m for lab in LABELS for m in MERCHANTS[lab]], kind * 4 + cycle % 4).alias("merchant"),
        _pick([w for lab in LABELS for w in KEYWORDS[lab]], kind * 3 + F.floor(k / 64) % 3).alias("keyword_hit"),
        _pick(CHANNEL_CYCLE, cycle % 6).alias("channel"),
        _pick(PLACES, F.col("nation") % len(PLACES)).alias("city"),
        _pick(PAYERS, F.floor(k / 5) % len(PAYERS)).alias("payer"),
        _pick(ACCOUNTS, F.floor(k / 11) % 3).alias("account_type"),
    )
    # some merchants lack their last letter
    spelled = F.when(k % 23 == 0, F.expr("left(merchant, length(merchant) - 1)")).otherwise(F.col("merchant"))
    with_ref = facts.withColumns({"reference": tx.reference_id(F.col("channel"), k), "spelled": spelled})
    refund = F.when((F.col("true_label") == fv.REFUND_LABEL) & (k % 5 == 0), F.trim(F.lit(fv.REFUND_PREFIX)))
    narrative = _pick_column([F.concat_ws(" ", refund, *parts) for parts in LAYOUTS], F.floor(k / 3) % len(LAYOUTS))
    line = F.col("line")
    glitched = F.when(k % 19 == 0, F.replace(F.lower(line), F.lit(" "), F.lit(" / "))).otherwise(line)
    income = F.col("true_label").startswith("INCOME")
    return with_ref.withColumn("line", narrative).select(
        "row_id", "transaction_id", "value_date",
        F.when(k % 37 == 0, F.date_add("value_date", -1)).when(k % 41 == 0, F.date_add("value_date", 9))
        .otherwise(F.date_add("value_date", (k % 4).cast("int"))).alias("posted_at"),
        F.when(k % 43 == 0, F.lit(0).cast("decimal(18,2)")).otherwise(F.col("price")).alias("amount"),
        F.when(k % 47 == 0, "USD").otherwise(fv.HOME_CURRENCY).alias("currency"),
        F.when(income != (k % 61 == 0), "CR").otherwise("DR").alias("dr_cr"),
        F.when(k % 59 == 0, F.lit(None)).when(k % 53 == 0, "").otherwise(F.col("merchant")).alias("merchant_name"),
        "reference",
        F.when(k % 31 == 0, F.lit(None)).otherwise(glitched).alias("narrative"),
        "channel", "account_type", "city", "keyword_hit", "category_id",
        display_name(F.col("true_label")).alias("category_display_name"),
        "true_label",
    )


def display_name(label: Column) -> Column:
    """``SHOPPING_ECOM`` -> ``Shopping Ecom``."""
    return F.initcap(F.replace(F.lower(label), F.lit("_"), F.lit(" ")))
