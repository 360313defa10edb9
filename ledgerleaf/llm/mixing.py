"""Mixing sources to target weights by Pareto order sampling.

Every document expects ``copies = least(max_copies, c * w)`` copies, where ``w``
is its inclusion weight and ``c`` is solved per source so that the expected
words of the source equal its target.  The whole part of that number is taken
for certain.  The fraction ``p`` is an inclusion probability, unequal from
document to document: the documents of a source are ranked by the odds of a
uniform draw over the odds of ``p``, and the ranking is cut where the words of
the sample come nearest to what is still missing from the target.

The cut is found without sorting a source: the ranking value is an integer of
48 bits, two histograms of 4,096 bins narrow the cut down to 2^-24 of a source,
and only the rows of that bin are ranked.  So a source that owns a third of all
rows costs no task more than its share.

Only DataFrame functions are used.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerleaf.llm.common import WORD, read, small, uniform
from ledgerleaf.operators.joins import join_skewed
from ledgerleaf.plans.storage import materialise

WEIGHTS = (5.0, 2.0, 1.0)
KEY_BITS, BIN_BITS = 48, 12


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """Never null, and in the order of the code points with null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def source_targets(stats: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5,
                   max_copies: float = 2.0) -> DataFrame:
    """(key, source_size, target) of a table with (key, size).

    Sources in key order take the weights in turn.  A target is the smaller of
    ``max_copies * source_size`` and ``weight * level``; the level is the one at
    which the targets sum to ``share`` of all sizes.  One row per source passes
    the windows without a partition; nothing else does.
    """
    sums = stats.groupBy("key").agg(F.sum("size").alias("source_size"))
    turn = F.pmod(F.row_number().over(W.orderBy("key")) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (turn + 1).cast("int"))
    rows = sums.withColumn("weight", weight).withColumn("cap", max_copies * F.col("source_size"))
    rows = rows.withColumn("ratio", F.col("cap") / F.col("weight"))
    everything = W.partitionBy()
    before = W.orderBy("ratio", "key").rowsBetween(W.unboundedPreceding, -1)
    onward = W.orderBy("ratio", "key").rowsBetween(W.currentRow, W.unboundedFollowing)
    level = (F.sum("source_size").over(everything) * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) \
        / F.sum("weight").over(onward)
    rows = rows.withColumn("level", level)
    # the first source, by size a unit of weight, that stays below its cap
    fits = F.min_by("level", F.when(F.col("level") <= F.col("ratio"), F.col("ratio"))).over(everything)
    # no level fits when share >= max_copies: then every source stands at its cap
    target = F.least(F.col("cap"), F.coalesce(F.col("weight") * fits, F.col("cap")))
    return rows.select("key", "source_size", target.cast("double").alias("target"))


def _factors(classes: DataFrame, targets: DataFrame, max_copies: float) -> DataFrame:
    """Per source the factor c; ``classes`` holds at most 64 rows a source: (key, w, size)."""
    lighter = W.partitionBy("key").orderBy("w")
    heavier = W.partitionBy("key").orderBy(F.desc("w")).rowsBetween(W.unboundedPreceding, -1)
    rows = classes.join(targets, "key").select(
        "key", "w", "target",
        F.sum(F.col("w") * F.col("size")).over(lighter).alias("open"),
        F.coalesce(F.sum("size").over(heavier), F.lit(0)).alias("full"))
    c = F.try_divide(F.col("target") - max_copies * F.col("full"), F.col("open"))
    rows = rows.withColumn("c", c)
    # the heaviest class that need not be cut down to max_copies
    fit = F.max_by("c", F.when((F.col("c") * F.col("w") <= max_copies + 1e-9) & (F.col("c") >= 0), F.col("w")))
    return rows.groupBy("key").agg(F.coalesce(fit, F.when(F.max("target") > 0, F.lit(max_copies))
                                              .otherwise(F.lit(0.0))).alias("c"))


def _expected(max_copies: float, c: str = "c", w: str = "w") -> tuple[Column, Column]:
    """Certain copies and the chance of one more."""
    copies = F.least(F.lit(float(max_copies)), F.col(c) * F.col(w))
    whole = F.floor(copies + 1e-9).cast("long")
    return whole, F.greatest(copies - whole, F.lit(0.0))


def _rank_value(draw: Column, p: Column) -> Column:
    """Odds of the draw over odds of p, as an integer that keeps the order; null where p is 0."""
    q = draw * (1 - p) / ((1 - draw) * p)
    value = F.least(F.floor(q / (1 + q) * float(1 << KEY_BITS)).cast("long"), F.lit((1 << KEY_BITS) - 1))
    return F.when(p > 0, value)


def _attach(rows: DataFrame, per_source: DataFrame, spread: str, key: str = "key") -> DataFrame:
    """Rows with the columns of their source: broadcast only when the table is small, else hot sources are salted."""
    if small(per_source):
        return rows.join(F.broadcast(per_source), key, "left")
    return join_skewed(rows, per_source, key, "left", spread_by=spread)


def _cuts(rows: DataFrame, factors: DataFrame) -> DataFrame:
    """(key, cut): the largest ranking value that is taken; rows: (key, h, size), factors: (key, missing)."""
    low = KEY_BITS - BIN_BITS
    state = factors.select("key", F.col("missing").cast("double").alias("left"))
    done = None
    for shift in (low, low - BIN_BITS):
        bins = rows.withColumn("bin", F.shiftright("h", shift)).groupBy("key", "bin").agg(F.sum("size").alias("size"))
        upto = F.sum("size").over(W.partitionBy("key").orderBy("bin"))
        bins = bins.join(state, "key").withColumn("upto", upto)
        hit = bins.where((F.col("upto") > F.col("left")) & (F.col("upto") - F.col("size") <= F.col("left")))
        hit = hit.groupBy("key").agg(F.min(F.struct("bin", (F.col("left") - F.col("upto") + F.col("size")).alias("left")))
                                     .alias("x")).select("key", "x.bin", "x.left")
        hit = materialise(hit)
        done = state.select("key") if done is None else done
        rows = _attach(rows, hit.withColumnRenamed("bin", "__bin").drop("left"), "h") \
            .where(F.shiftright("h", shift) == F.col("__bin")).drop("__bin")
        last, state = hit.select("key", (F.shiftleft("bin", shift) - 1).alias("floor")), hit.select("key", "left")
    ties = rows.groupBy("key", "h").agg(F.sum("size").alias("size")).join(state, "key")
    before = F.sum("size").over(W.partitionBy("key").orderBy("h")) - F.col("size")
    taken = ties.withColumn("before", before).where(F.col("before") + F.col("size") / 2 <= F.col("left"))
    taken = taken.groupBy("key").agg(F.max("h").alias("h"))
    # a source without a hit takes everything
    return (done.join(last, "key", "left").join(taken, "key", "left")
            .select("key", F.coalesce("h", "floor", F.lit(1 << KEY_BITS)).alias("cut")))


def document_weight(size: Column) -> Column:
    """Default inclusion weight: 1 + log2 of the size, 1 to 64; longer documents are likelier to get a copy."""
    return F.least(F.lit(64), 1 + F.floor(F.log2(1 + size))).cast("long")


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, max_copies: int = 2, seed: int = 6,
        weight_of: Callable[[Column], Column] = document_weight) -> DataFrame:
    """``docs`` with __size, __source_size, __target and __copies (0 to ``max_copies``).

    ``weight_of`` maps a size to the inclusion weight, a whole number from 1 to 64.

    Null text has size 0; a null source is a source of its own.  Documents of size 0 add nothing to
    any sum.  Rows that agree in id and source share a draw, so repeated rows are taken alike; rows without an id do
    if they agree in text and source.
    An empty table gives an empty table.  Other columns keep their names; one of the four added names
    that ``docs`` has already is replaced.
    """
    size = words(F.col(text_col))
    own = docs.drop("__size", "__source_size", "__target", "__copies").withColumns({
        "__size": size, "__key": source_key(F.col(source_col)),
        # a null part leaves the hash as it is
        "__draw": uniform(F.col(id_col), F.col(source_col), F.when(F.col(id_col).isNull(), F.col(text_col)), seed=seed)})
    stats = materialise(own.select(F.col("__key").alias("key"), F.col("__size").alias("size"),
                                   F.col("__draw").alias("draw"), weight_of(F.col("__size")).alias("w")))
    targets = materialise(source_targets(stats, weights, share, max_copies))
    classes = stats.groupBy("key", "w").agg(F.sum("size").alias("size"))
    factors = materialise(_factors(classes, targets, max_copies))
    whole, p = _expected(max_copies)
    rows = _attach(stats, factors, "draw").select("key", "size", whole.alias("whole"), p.alias("p"), "draw")
    rows = rows.withColumn("h", _rank_value(F.col("draw"), F.col("p")))
    sums = rows.groupBy("key").agg(F.sum(F.col("whole") * F.col("size")).alias("sure"))
    missing = targets.join(sums, "key").select(
        "key", F.greatest(F.col("target") - F.col("sure"), F.lit(0.0)).alias("missing"))
    cuts = _cuts(rows.where("h is not null").select("key", "h", "size"), missing)
    plan = materialise(targets.join(factors, "key").join(cuts, "key").select(
        "key", *(F.col(c).alias(f"__{c}") for c in ("source_size", "target", "c", "cut"))))

    whole, p = _expected(max_copies, "__c", "__w")
    out = _attach(own.withColumn("__w", weight_of(F.col("__size"))), plan.withColumnRenamed("key", "__key"), "__draw", "__key")
    extra = F.coalesce(_rank_value(F.col("__draw"), p) <= F.col("__cut"), F.lit(False)).cast("long")
    return out.withColumn("__copies", whole + extra).drop("__key", "__draw", "__w", "__c", "__cut")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of every document under the weights 5, 2, 1."""
    mixed = mix(read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"),
                        F.col("__target").alias("target"), (F.col("__copies") * F.col("__size")).alias("taken"))


QUERIES = {"op6_mix_sources": query}
