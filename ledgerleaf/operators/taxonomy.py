"""The label dimension: loading, enrichment, roll-up to parents."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerleaf.operators.joins import join_skewed
from ledgerleaf.plans.storage import materialise, new_path

DEFAULT_FILE = Path(__file__).resolve().parent.parent / "data" / "taxonomy.json"

_S, _B = T.StringType(), T.BooleanType()
_LIST = T.ArrayType(_S)
TAXONOMY_SCHEMA = T.StructType([
    T.StructField(name, kind) for name, kind in [
        ("id", _S), ("display_name", _S), ("description", _S), ("group", _S), ("primary", _B), ("parent_id", _S),
        ("budget_bucket", _S), ("default_direction", _S), ("default_recurring", _B), ("channel_tags", _LIST),
        ("instrument_tags", _LIST), ("mcc_hints", T.ArrayType(T.IntegerType())), ("upi_merchant_bucket", _S),
        ("risk_tags", _LIST), ("tax_relevant", _B), ("keywords", _LIST), ("example_merchants", _LIST),
        ("example_descriptions", _LIST),
    ]])


def read_taxonomy(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Taxonomy from JSON lines, or with ``multi_line`` from a JSON array; a few dozen rows."""
    return spark.read.schema(TAXONOMY_SCHEMA).option("multiLine", multi_line).json(path)


def default_taxonomy(spark: SparkSession) -> DataFrame:
    """The small taxonomy that ships with the package."""
    rows = json.loads(DEFAULT_FILE.read_text())
    return spark.createDataFrame([tuple(r.get(n) for n in TAXONOMY_SCHEMA.names) for r in rows], TAXONOMY_SCHEMA)


def stored_default(spark: SparkSession) -> str:
    """Path of a copy of the shipped taxonomy as JSON lines where every executor can read it."""
    path = new_path(spark, "taxonomy")
    default_taxonomy(spark).coalesce(1).write.json(path)
    return path


def taxonomy_enrich(df: DataFrame, label: str, taxonomy: DataFrame) -> DataFrame:
    """Add display name, group, budget bucket, direction and tax flag of the label."""
    side = taxonomy.select(
        F.col("id").alias(label), F.col("display_name").alias("label_name"), F.col("group").alias("label_group"),
        "budget_bucket", "default_direction", "tax_relevant")
    return df.join(side, label, "left")


def taxonomy_rollup(df: DataFrame, label: str, taxonomy: DataFrame, amount: str = "amount") -> DataFrame:
    """Rows and amount per top label: children count toward their parent."""
    child = taxonomy.select("id", "parent_id").alias("child")
    parent = taxonomy.select(F.col("id").alias("pid"), F.col("display_name").alias("pname")).alias("parent")
    names = taxonomy.select(F.col("id").alias("own"), F.col("display_name").alias("own_name"))
    top = child.join(parent, F.col("child.parent_id") == F.col("parent.pid"), "left").join(
        names, F.col("child.id") == F.col("own")).select(
        F.col("child.id").alias(label), F.coalesce("pid", "id").alias("top_label"),
        F.coalesce("pname", "own_name").alias("top_name"))
    return df.join(top, label, "left").groupBy(
        F.coalesce("top_label", F.col(label)).alias("top_label"), "top_name").agg(
        F.count(F.lit(1)).alias("total_rows"), F.sum(amount).alias("amount"))


def closure(edges: DataFrame) -> DataFrame:
    """(node, ancestor, distance) for every ancestor of every node, whatever the depth; ``edges`` has (node, parent).

    Every round joins the known paths with themselves, so a chain of n levels takes log2(n) rounds.  Several parents are
    allowed; the shortest distance counts.  A node on a cycle is its own ancestor (see ``cycles``).  Edges without a parent
    are dropped.  An ancestor of a third of all nodes is salted.
    """
    paths = materialise(edges.where("node is not null and parent is not null").select("node", F.col("parent").alias("ancestor")).distinct()
                        .withColumn("distance", F.lit(1)))
    n = paths.count()
    while n:
        further = paths.select(F.col("node").alias("ancestor"), F.struct("ancestor", "distance").alias("__up"))
        longer = join_skewed(paths, further, "ancestor", "inner", spread_by="node").select(
            "node", F.col("__up.ancestor").alias("ancestor"), (F.col("distance") + F.col("__up.distance")).alias("distance"))
        paths = materialise(paths.unionByName(longer).groupBy("node", "ancestor").agg(F.min("distance").alias("distance")))
        before, n = n, paths.count()
        if n == before:
            break
    return paths


def cycles(paths: DataFrame) -> DataFrame:
    """(node, length) of every node of a ``closure`` that reaches itself."""
    return paths.where(F.col("node") == F.col("ancestor")).select("node", F.col("distance").alias("length"))


def rollup(facts: DataFrame, node: str, paths: DataFrame, *amounts: str) -> DataFrame:
    """(ancestor, total_rows, *amounts, depth): rows and sums of each node with all below it; ``depth`` is how far down they lie.

    Facts are summed per node before they meet the paths, so a hot node is one row.
    """
    own = facts.groupBy(F.col(node).alias("node")).agg(F.count(F.lit(1)).alias("total_rows"), *(F.sum(a).alias(a) for a in amounts))
    up = paths.where("node != ancestor").unionByName(own.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("distance")))
    return up.join(own, "node").groupBy("ancestor").agg(
        F.sum("total_rows").alias("total_rows"), *(F.sum(a).alias(a) for a in amounts), F.max("distance").alias("depth"))
