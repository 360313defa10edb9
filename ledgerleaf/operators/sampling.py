"""Samples and splits in hash order, without a global sort.

A row's place is its rank by md5(id, seed).  A histogram over the first hash
digits shows in which digit group each cut falls; only rows of those groups
are ranked, all others are decided by comparing the digits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerleaf import fixed_values as fv

DIGITS = 4   # 65,536 groups


def hash_order(row_id: str, seed) -> Column:
    return F.md5(F.concat(F.col(row_id).cast("string"), F.lit(f":{seed}")))


def hash_bands(df: DataFrame, row_id: str, seed, sizes: list[tuple[str, Column]], *, group: str | None = None,
               quotas: DataFrame | None = None, digits: int = DIGITS) -> DataFrame:
    """Add ``band``: the first ``sizes[0]`` rows in hash order get its name, the
    next ``sizes[1]`` rows the next name; later rows are dropped.

    Sizes are expressions over ``n`` (rows of the group) and the columns of
    ``quotas``, a table with one row per group.
    """
    by = [group] if group else ["__all"]
    source = df if group else df.withColumn("__all", F.lit(0))
    hashed = source.withColumn("__h", hash_order(row_id, seed)).withColumn("__d", F.substring("__h", 1, digits))

    counts = hashed.groupBy(*by, "__d").agg(F.count(F.lit(1)).alias("__c"))
    upto = W.partitionBy(*by).orderBy("__d")
    places = counts.select(
        *by, "__d", (F.sum("__c").over(upto) - F.col("__c")).alias("before"),
        F.sum("__c").over(W.partitionBy(*by)).alias("n"))
    if quotas is not None:
        places = places.join(quotas, by)
    total, cuts = F.lit(0), []
    for name, size in sizes:
        total = total + size
        cuts.append((name, total))
    # per group and cut: the digit group in which the cut falls, and the cut itself
    cut_table = places.groupBy(*by).agg(*[
        F.max(F.when(F.col("before") < cut, F.struct(
            F.col("__d").alias("d"), F.col("before").alias("before"), cut.cast("long").alias("cut")))).alias(f"__cut{i}")
        for i, (_, cut) in enumerate(cuts)
    ])
    marked = hashed.join(cut_table, by)
    at_edge = F.lit(False)
    last = F.col(f"__cut{len(cuts) - 1}")
    for i in range(len(cuts)):
        at_edge = at_edge | F.coalesce(F.col("__d") == F.col(f"__cut{i}.d"), F.lit(False))

    def band_by(test) -> Column:
        out = None
        for i, (name, _) in enumerate(cuts):
            cond = F.coalesce(test(F.col(f"__cut{i}")), F.lit(False))
            out = F.when(cond, name) if out is None else out.when(cond, name)
        return out

    inside = marked.where(~at_edge & (F.col("__d") < last["d"])).withColumn(
        "band", band_by(lambda c: F.col("__d") < c["d"]))
    before = F.coalesce(*[F.when(F.col("__d") == F.col(f"__cut{i}.d"), F.col(f"__cut{i}.before"))
                          for i in range(len(cuts))])
    rank = before + F.row_number().over(W.partitionBy(*by, "__d").orderBy("__h", row_id))
    edge = marked.where(at_edge).withColumn("__rank", rank).withColumn(
        "band", band_by(lambda c: F.col("__rank") <= c["cut"])).where(F.col("band").isNotNull())
    keep = [*df.columns, "band"]
    return inside.select(*keep).unionByName(edge.select(*keep))


def train_test_split(df: DataFrame, row_id: str, train_size, test_size, seed=42) -> DataFrame:
    """``band`` is 'train' for the first rows in hash order and 'test' for the next."""
    as_col = lambda s: s if isinstance(s, Column) else F.lit(s)
    return hash_bands(df, row_id, seed, [("train", as_col(train_size)), ("test", as_col(test_size))])


def coarse_calibration_sample(df: DataFrame, row_id: str, size=12_000, divisor=5, seed=42) -> DataFrame:
    """min(size, n / divisor) rows."""
    return hash_bands(df, row_id, seed, [("cal", F.least(F.lit(size), F.floor(F.col("n") / divisor)))])


def fine_calibration_sample(df: DataFrame, row_id: str, group: str, size=2_000, least=200, frac=0.2,
                            seed=123) -> DataFrame:
    """Per group min(n, size, max(least, frac * n)) rows."""
    k = F.least(F.col("n"), F.lit(size), F.greatest(F.lit(least), F.floor(F.col("n") * frac)))
    return hash_bands(df, row_id, seed, [("cal", k)], group=group)


def label_allocation(df: DataFrame, label: str, total: int, weights: dict | None = None,
                     default: float = fv.LABEL_WEIGHT_DEFAULT) -> DataFrame:
    """(label, quota): ``total`` rows shared by weight, rounded down, and one more
    for the labels with the largest fractions.  One row per label throughout."""
    pairs = [F.lit(x) for kv in (weights or fv.LABEL_WEIGHTS).items() for x in kv]
    one = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(label)), F.lit(default)).cast("decimal(9,4)")
    labels = df.select(label).distinct().withColumn("w", one)
    everything = W.partitionBy(F.lit(0))
    share = F.col("w").cast("double") * total / F.sum("w").over(everything).cast("double")
    floored = labels.withColumn("share", share).withColumn("base", F.floor("share"))
    spare = F.lit(total) - F.sum("base").over(everything)
    place = F.row_number().over(everything.orderBy(F.desc(F.round(F.col("share") - F.col("base"), 9)), F.asc(label)))
    return floored.select(label, (F.col("base") + F.when(place <= spare, 1).otherwise(0)).alias("quota"))


def stratified_allocation(df: DataFrame, row_id: str, label: str, total: int, seed=42,
                          weights: dict | None = None) -> DataFrame:
    """Rows per label up to its share of ``total``."""
    quotas = label_allocation(df, label, total, weights)
    return hash_bands(df, row_id, seed, [("kept", F.col("quota"))], group=label, quotas=quotas).drop("band")
