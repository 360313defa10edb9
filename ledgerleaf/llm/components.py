"""Connected components and linking of rows that meet in lists, for the near-duplicate operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerleaf.llm.common import Stored
from ledgerleaf.plans.storage import materialise

#: Ids up to this number are broadcast to filter documents (a few ten MB); beyond, both sides are shuffled.
FILTER_IDS = 2_000_000
STAR_ROUNDS = 3
#: A round of pivots in which less than one of so many pairs is linked is the last.
FEW_LINKS = 50


def by_ids(docs: DataFrame, ids: DataFrame, id_col: str, how: str) -> DataFrame:
    """Semi or anti join on a column of distinct ids."""
    few = ids.limit(FILTER_IDS + 1).count() <= FILTER_IDS
    return docs.join(F.broadcast(ids) if few else ids.hint("merge"), id_col, how)


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable, for every id of ``edges`` (a, b) but the smallest ones themselves.

    Alternating stars: neighbours above a node move to the smallest neighbour, then those below, until all
    edges point at the smallest id.  Each round is cut by a checkpoint; the number of rounds grows with the logarithm
    of the longest path.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()
    e = materialise(e)
    seen = None
    while True:
        state = e.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
        if state == seen or not state.n:
            return e.select(F.col("u").alias("id"), F.col("v").alias("component"))
        seen = state
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialise(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())


def label(rows: DataFrame, found: DataFrame | None) -> DataFrame:
    """Rows (id, ...) with their component; an id without links is its own."""
    if found is None:
        return rows.withColumn("component", F.col("id"))
    return rows.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))


def link_lists(lists: DataFrame, able: Column, verify, first: list[str], pivots: int = 0,
               known: DataFrame | None = None) -> DataFrame | None:
    """Components of the rows that meet in ``lists``; None if nothing is linked.

    ``lists`` has (key, id, component-free columns).  ``able`` is a condition on two rows a and b of a list,
    ``verify`` maps distinct pairs (a, b) to those that are linked, ``first`` orders the rows of a list so that its head
    resembles most others.

    In a few rounds the head of each list meets one row of every other component in it; this joins
    large groups of copies at a cost that is linear in the lists.  Then every row that is not in the head's component
    meets all rows of other components, so that no link between two components is missed; rows of one component are
    never paired.

    With ``pivots``, up to so many rounds choose the head anew, by hash; it meets every row of the other components in its
    list, without a join, and one pair for each of them is verified.  Groups whose members resemble their
    neighbours more than any one head then come together before the last round.

    ``known`` are links (a, b) found elsewhere; they count from the first round on.
    """
    found = None if known is None or known.isEmpty() else components(known)
    columns = [c for c in lists.columns if c not in ("key", "id")]
    order, whole = F.struct(*first, "id"), W.partitionBy("key")
    left: Stored | None = None
    stars, turn = pivots or STAR_ROUNDS, 0
    while True:
        # a list whose rows are in one component stays so: the next round reads only the others
        rows = label(lists if left is None else left.df.select("key", "id", *columns), found)
        if pivots and turn:  # in a list of two rows the head has met all
            order = F.struct(F.xxhash64("id", F.lit(turn)), "id")
            rows = rows.withColumn("rows", F.count(F.lit(1)).over(whole)).where("rows > 2").drop("rows")
        if pivots:
            rows = rows.withColumn("pivot", F.min_by(F.struct("id", "component", *columns), order).over(whole))
        turn += 1
        rows = rows.withColumns({"head": F.min_by("component", order).over(whole), "low": F.min("component").over(whole),
                                 "high": F.max("component").over(whole)}).where("low != high").drop("low", "high")
        before, left = left, Stored(rows, "lists")
        if before is not None:
            before.drop()
        rows = left.df
        if rows.isEmpty():
            break
        last = stars == 0
        if pivots and not last:
            met = rows.where("component != head").select(
                "component", *(F.col(c).alias(f"a_{c}") for c in ("id", *columns)),
                *(F.col("pivot")[c].alias(f"b_{c}") for c in ("id", *columns))).where(able)
            met = met.groupBy("b_id", "component").agg(F.min("a_id").alias("a_id"))
        else:
            if not last:  # one row a component and list
                packed = F.min(F.struct(*first, "id", *(c for c in columns if c not in first))).alias("x")
                rows = rows.groupBy("key", "component", "head").agg(packed).select("key", "component", "head", "x.*")
            a = rows.where("component != head").select("key", *(F.col(c).alias(f"a_{c}") for c in ("id", "component", *columns)))
            b = rows if last else rows.where("component = head")
            b = b.select("key", "head", *(F.col(c).alias(f"b_{c}") for c in ("id", "component", *columns)))
            once = (F.col("b_component") == F.col("head")) | (F.col("a_id") < F.col("b_id"))
            met = a.join(b, (a["key"] == b["key"]) & (F.col("a_component") != F.col("b_component")) & once & able)
        pairs = met.select(F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b")).distinct()
        pairs = materialise(pairs)
        new = materialise(verify(pairs))
        some = new.count()
        if some:
            # components so far are stars: their links stand for all that made them
            linked = None if found is None else found.select(F.col("id").alias("a"), F.col("component").alias("b"))
            found = components(new if linked is None else linked.unionByName(new))
        if last:
            break
        # heads that are linked to few of those they met would be to fewer yet
        few = pivots and FEW_LINKS * some < pairs.count()
        stars = 0 if few or not some else stars - 1
    left.drop()
    return found
