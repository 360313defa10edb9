"""Places of rows in the order of their key, without a task that holds all rows of a key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerleaf.llm.common import Stored


def numbered(rows: DataFrame, key: str, order: list[str], name: str, size: str | None = None) -> tuple[DataFrame, Stored]:
    """``rows`` with ``idx``, the place from 0 of a row among those of its key in the order of ``order`` (nulls first).

    With ``size``, ``start`` is the sum of that column over the rows before.  Null is a key like any other.  The second
    value is the table that holds the rows; drop it when the first is not needed any more.

    Rows are dealt by ranges of (key, order), so a key with a third of all rows lies in many parts.  Windows run inside
    a part; what stands before a part is a sum over (key, part).  A part begins inside one key at most, so no more rows
    than there are parts carry such a sum, and those are broadcast.
    """
    dealt = rows.repartitionByRange(key, *order).withColumn("__part", F.spark_partition_id())
    stored = Stored(dealt, name)
    inside = W.partitionBy(key, "__part").orderBy(*order)
    before = W.partitionBy(key).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    sums = {"n": F.count(F.lit(1))} | ({"size": F.sum(size)} if size else {})
    parts = stored.df.groupBy(key, "__part").agg(*(v.alias(k) for k, v in sums.items()))
    parts = parts.select(key, "__part", *(F.sum(k).over(before).alias(f"__{k}") for k in sums)).where("__n > 0")
    parts = parts.withColumnsRenamed({key: "__key", "__part": "__of"})
    local = {"idx": F.row_number().over(inside) - 1}
    if size:
        local["start"] = F.sum(size).over(inside.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col(size)
    out = stored.df.withColumns(local).join(
        F.broadcast(parts), F.col(key).eqNullSafe(F.col("__key")) & (F.col("__part") == F.col("__of")), "left")
    moved = {c: (F.col(c) + F.coalesce(f"__{k}", F.lit(0))).cast("long") for c, k in zip(local, sums, strict=True)}
    return out.withColumns(moved).drop("__part", "__of", "__key", *(f"__{k}" for k in sums)), stored
