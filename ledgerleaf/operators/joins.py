"""Join helpers: broadcast behind a size bound, salted shuffle join beyond it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerleaf.plans.storage import materialise

BROADCAST_LIMIT_BYTES = 512 * 1024 * 1024
SALTS = 64
#: Rows of one key that a task may hold before they are spread.
COPIES_A_TASK = 1_000_000
#: Tables up to so many rows are broadcast; beyond, both sides are shuffled.
BROADCAST_ROWS = 200_000


def few(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether a table has at most ``rows`` rows; reads no more than that."""
    return df.limit(rows + 1).count() <= rows


def join_bounded(left: DataFrame, right: DataFrame, key: str, *, max_rows: int, row_bytes: int,
                 spread_by: str, limit: int = BROADCAST_LIMIT_BYTES, salts: int = SALTS) -> DataFrame:
    """Inner join of a large table with a table whose size has an upper bound.

    Within ``limit`` the right side is broadcast.  Beyond it both sides are
    shuffled on (key, salt): hot keys of the left side (a word that most rows
    hold) are spread over ``salts`` tasks by ``spread_by``.
    """
    if max_rows * row_bytes <= limit:
        return left.join(F.broadcast(right), key)
    salted_left = left.withColumn("__salt", F.pmod(F.xxhash64(spread_by), F.lit(salts)))
    salted_right = right.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return salted_left.join(salted_right, [key, "__salt"]).drop("__salt")


def join_skewed(left: DataFrame, right: DataFrame, key: str, how: str = "left", *,
                spread_by: str, salts: int = SALTS) -> DataFrame:
    """Join to a table with one row per key when one key may own much of ``left``.

    The right row of each key is repeated once per salt only for hot keys:
    those with more than 1/1000 of the rows, so at most 1,000 of them exist
    and the list of hot keys may be broadcast whatever the data size.  The rows
    of a hot key are spread by ``spread_by``, a column unique per row.
    """
    if how not in ("left", "inner"):
        raise ValueError("only left and inner joins are supported")
    counts = left.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    total = left.agg(F.count(F.lit(1)).alias("n")).scalar()
    hot = counts.where(F.col("__n") * 1000 > total).select(key, F.lit(True).alias("__hot"))
    hot = F.broadcast(hot)
    last = F.when(F.col("__hot"), F.lit(salts - 1)).otherwise(F.lit(0))
    spread = left.join(hot, key, "left").withColumn(
        "__salt", F.when(F.col("__hot"), F.pmod(F.xxhash64(spread_by), F.lit(salts))).otherwise(F.lit(0)).cast("int")
    ).drop("__hot")
    repeated = right.join(hot, key, "left").withColumn(
        "__salt", F.explode(F.sequence(F.lit(0), last))
    ).drop("__hot")
    return spread.join(repeated, [key, "__salt"], how).drop("__salt")


def magnitude(value: Column) -> Column:
    """A bucket number that never falls as the value grows: the power of two, negative below zero."""
    v = value.cast("double")
    power = lambda x: F.floor(F.log2(x)) + 1
    return F.when(v >= 1, power(v)).when(v <= -1, -power(-v)).otherwise(F.when(v.isNotNull(), 0)).cast("int")


def range_join(points: DataFrame, ranges: DataFrame, value: str, low: str, high: str, keys: list[str]) -> DataFrame:
    """Left join of ``points`` with the ranges of equal ``keys`` that hold ``value``: low <= value < high.

    A range is listed under each power of two that it touches, so the join is one of equal keys and buckets, never of
    all pairs.  Null limits are open ends.  A point in several ranges comes once for each; one in none, or with a null
    value or key, comes once with nulls.  Ranges are broadcast up to a checked size; beyond it both sides are shuffled by
    keys and bucket, and the points of a bucket that owns more than 1/1000 of them are salted.
    """
    ends = (F.coalesce(magnitude(F.col(low)), F.lit(-1_024)), F.coalesce(magnitude(F.col(high)), F.lit(1_024)))
    listed = ranges.withColumn("__bucket", F.explode(F.sequence(*ends, F.lit(1))))
    listed = listed.withColumn("__at", F.xxhash64(*keys, "__bucket")).withColumnsRenamed({k: f"__{k}" for k in keys}).drop("__bucket")
    marked = points.withColumns({"__at": F.xxhash64(*keys, magnitude(F.col(value))), "__point": F.monotonically_increasing_id()})
    same = [F.col(k) == F.col(f"__{k}") for k in keys]
    inside = (F.coalesce(F.col(low) <= F.col(value), F.lit(True)) & F.coalesce(F.col(value) < F.col(high), F.lit(True))
              & F.col(value).isNotNull())
    for c in same:
        inside = inside & c
    extra = [*(f"__{k}" for k in keys), "__at", "__point"]
    if few(listed):
        small = F.broadcast(listed.withColumnRenamed("__at", "__of"))
        return marked.join(small, (F.col("__at") == F.col("__of")) & inside, "left").drop(*extra, "__of")
    # the salted join compares buckets alone; points that no range holds are put back
    marked = materialise(marked)
    names = [c for c in ranges.columns if c not in keys]
    packed = listed.select("__at", F.struct(*(f"__{k}" for k in keys), *names).alias("__range"))
    unpacked = [F.col(f"__range.{c}").alias(c) for c in (*(f"__{k}" for k in keys), *names)]
    met = join_skewed(marked, packed, "__at", "inner", spread_by="__point").select(*marked.columns, *unpacked).where(inside)
    met = materialise(met)
    none = marked.join(met.select("__point"), "__point", "left_anti")
    return met.drop(*extra).unionByName(none.drop(*extra), allowMissingColumns=True)


def with_copies(df: DataFrame, key: str, spread_by: str, column: str = "copies", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Add the number of rows that share ``key``; rows are counted once.

    Only keys with copies meet the rows again: they are broadcast up to a checked number.  Beyond it rows and keys are
    shuffled, and a key with more than ``COPIES_A_TASK`` rows is spread over as many tasks as it needs.  Null keys count
    as one row each, having no equals.
    """
    copies = materialise(df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias(column)).where(F.col(column) > 1))
    if few(copies, limit):
        return df.join(F.broadcast(copies), key, "left").withColumn(column, F.coalesce(column, F.lit(1).cast("long")))
    parts = F.ceil(F.col(column) / COPIES_A_TASK).cast("int")
    hot = copies.where(F.col(column) > COPIES_A_TASK).select(key, parts.alias("__parts"))
    hot = F.broadcast(hot) if few(hot) else hot
    spread = df.join(hot, key, "left").withColumn(
        "__salt", F.coalesce(F.pmod(F.xxhash64(spread_by), F.col("__parts")).cast("int"), F.lit(0))).drop("__parts")
    repeated = copies.withColumn("__salt", F.explode(F.sequence(F.lit(0), parts - 1)))
    return spread.join(repeated, [key, "__salt"], "left").drop("__salt").withColumn(column, F.coalesce(column, F.lit(1).cast("long")))
