"""A manifest of a dataset as a Merkle tree per group and one over the groups, by lag and lead windows.

A node of level l stands on the row of its first leaf, so siblings of that level are 2**l rows apart: one lag and one lead
column with this fixed offset, masked by the slot of the node (left or right) and by the length of the run (a last one
may be alone), give every sibling, and the row of the first child hashes the parent.  The way down is as regular: a left
child stands on the row of its parent and a right child 2**l rows after it, so one lag column hands on what is known of
the path above.

Windows hold blocks of 2**LEVELS leaves; runs of two never cross a block's edge.  The tops of all blocks are leaves of the
next tier, which is 1024 times smaller, until each group has one block.  So no task holds a group, however large, and all
levels of a tier take one shuffle and one sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerleaf.llm.common import Stored, read, small, sql_crc32
from ledgerleaf.llm.positions import numbered
from ledgerleaf.operators.joins import join_skewed

LEVELS = 10
#: An entry of a path: where the sibling stands and its digest; a node alone in its run has no digest.
RIGHT, LEFT, ALONE = "r", "l", "a"
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*(p.cast("binary") for p in parts)), 256)


def leaf_digest(fields: list[Column]) -> Column:
    """Each field as ``-`` if null, else its UTF-8 byte count, a colon and its value."""
    told = []
    for field in fields:
        value = field.cast("string")
        told.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return digest(*told)


def group_key(group: Column) -> Column:
    """Never null, and in the order of the bytes with null first."""
    return F.coalesce(F.concat(F.lit("1"), group), F.lit("0"))


def _tier(nodes: DataFrame, levels: int) -> DataFrame:
    """``nodes`` (key, idx, n, digest, ...) with ``block``, ``path`` inside it and, on its first row, the block's ``top``."""
    rows = nodes.withColumn("block", F.shiftright("idx", levels)).withColumnRenamed("digest", "d")
    w = W.partitionBy("key", "block").orderBy("idx")
    idx = F.col("idx")
    slot = lambda level: F.shiftright(idx, level).bitwiseAND(F.lit(1))
    stands = lambda level: idx.bitwiseAND(F.lit((1 << level) - 1)) == 0
    for level in range(levels):
        step = 1 << level
        more, d = F.col("n") > step, F.col("d")  # of one node nothing is hashed
        rows = rows.withColumns({"after": F.lead("d", step).over(w), "before": F.lag("d", step).over(w)})
        sibling = F.when(slot(level) == 1, F.concat(F.lit(LEFT), "before")).when(
            F.col("after").isNotNull(), F.concat(F.lit(RIGHT), "after")).otherwise(F.lit(ALONE))
        parent = F.when(more, digest(d, F.coalesce("after", F.lit("")))).otherwise(d)
        rows = rows.withColumns({f"s{level}": F.when(stands(level) & more, sibling), "d": F.when(stands(level + 1), parent)}) \
            .drop("after", "before")
    rows = rows.withColumnRenamed("d", "top").withColumn("path", F.when(stands(levels), ""))
    for level in reversed(range(levels)):
        above = F.when(slot(level) == 1, F.lag("path", 1 << level).over(w)).otherwise(F.col("path"))
        rows = rows.withColumn("up", above)
        own = F.col(f"s{level}")
        path = F.when(own.isNull(), F.col("up")).when(F.col("up") == "", own).otherwise(F.concat_ws(",", own, "up"))
        rows = rows.withColumn("path", F.when(stands(level), path)).drop("up", f"s{level}")
    return rows


def tree(nodes: DataFrame, levels: int = LEVELS) -> tuple[DataFrame, list[Stored]]:
    """``nodes`` (key, idx from 0 without gaps, n rows of the key, digest, ...) with ``path`` and ``top``, its key's topmost digest.

    ``path`` has an entry per level from the leaves up, comma-separated.  Also gives the stored tables behind the result.
    """
    tier = Stored(_tier(nodes.withColumn("leaf", F.col("digest")), levels), "merkle-tier")
    tops = tier.df.where("top is not null")
    largest = tier.df.agg(F.max("n").alias("n")).first().n or 0
    if largest > 1 << levels:
        upper, held = tree(tops.select("key", F.col("block").alias("idx"), F.ceil(F.col("n") / (1 << levels)).alias("n"),
                                       F.col("top").alias("digest")), levels)
        upper = upper.select("key", F.col("idx").alias("block"), F.col("path").alias("up"), "top")
    else:
        upper, held = tops.select("key", "block", F.lit("").alias("up"), "top"), []
    path = F.when(F.col("up") == "", F.col("path")).when(F.col("path") == "", F.col("up")).otherwise(F.concat_ws(",", "path", "up"))
    rows = tier.df.drop("top").join(upper, ["key", "block"]).withColumn("path", path)
    return rows.drop("up", "block"), [tier, *held]


def with_counts(rows: DataFrame, key: str, spread_by: str) -> DataFrame:
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    if small(counts):
        return rows.join(F.broadcast(counts), key)
    return join_skewed(rows, counts, key, "inner", spread_by=spread_by)


def entries(path: Column) -> Column:
    return F.filter(F.split(path, ",", -1), lambda x: x != "")


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""

    def step(node: Column, entry: Column) -> Column:
        other, side = F.substr(entry, F.lit(2)), F.substr(entry, F.lit(1), F.lit(1))
        return digest(F.when(side == LEFT, F.concat(other, node)).otherwise(F.concat(node, other)))

    return F.aggregate(entries(path), leaf, step)


def proof_digest(path: Column) -> Column:
    return digest(F.array_join(F.transform(entries(path), lambda x: F.substr(x, F.lit(2))), ""))


def manifest(leaves: DataFrame, levels: int = LEVELS) -> tuple[DataFrame, list[Stored]]:
    """(id, group) leaves with ``path`` to the root, ``subroot`` and ``root``; ``leaves`` has id, group, leaf and more.

    Leaves of a group ascend by id (null first), equal ids by leaf; equal rows are leaves of their own.  Groups ascend by
    the bytes of their name, null first.  A lone leaf is its group's subroot, a lone subroot the root.  An empty table has no
    rows.
    """
    keyed = leaves.withColumn("key", group_key(F.col("group"))).drop("group")
    placed, stored = numbered(keyed, "key", ["id", "leaf"], "merkle-leaves")
    placed = with_counts(placed, "key", "idx").withColumnRenamed("leaf", "digest")
    below, held = tree(placed, levels)
    below = below.withColumnsRenamed({"top": "subroot", "path": "low"})
    # the subroots are leaves of one more tree
    subroots = below.where("idx = 0").select("key", "subroot")
    first, stored2 = numbered(subroots.withColumn("all", F.lit("")), "all", ["key"], "merkle-groups")
    n = stored2.df.count()
    tops, held2 = tree(first.select(F.col("all").alias("key"), "idx", F.lit(n).cast("long").alias("n"), F.col("subroot").alias("digest"),
                                    F.col("key").alias("group")), levels)
    tops = tops.select(F.col("group").alias("key"), F.col("path").alias("high"), F.col("top").alias("root"))
    joined = below.join(F.broadcast(tops), "key") if small(tops) else join_skewed(below, tops, "key", "inner", spread_by="idx")
    path = F.when(F.col("high") == "", F.col("low")).when(F.col("low") == "", F.col("high")).otherwise(F.concat_ws(",", "low", "high"))
    return joined.withColumn("path", path).drop("low", "high", "key", "idx", "n"), [stored, stored2, *held, *held2]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's proof, and whether a copy of the table in which some rows were changed still proves."""
    docs = read(spark, sf_dir, "documents")
    fields = [F.col(c) for c in FIELDS]
    changed = [F.try_add(f, F.lit(1)) if name == "n_chars" else f for name, f in zip(FIELDS, fields, strict=True)]
    tampered = F.col("n_chars").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0)
    leaves = docs.select(F.col("doc_id").alias("id"), F.col("lang").alias("group"), leaf_digest(fields).alias("leaf"),
                         F.when(tampered, leaf_digest(changed)).alias("changed"))
    rows, _ = manifest(leaves)
    rows = rows.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"),
                       fold(F.coalesce("changed", "leaf"), F.col("path")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def _sql_leaf(n_chars: str) -> str:
    told = (f"coalesce(octet_length(encode({f}::VARCHAR))::VARCHAR || ':' || {f}::VARCHAR, '-')"
            for f in (n_chars if f == "n_chars" else f for f in FIELDS))
    return f"sha256({' || '.join(told)})"


def _sql_levels(name: str, leaves: str) -> str:
    """All nodes of the trees over ``leaves`` (key, idx, n, d), and the entries of each leaf's path."""
    return f"""
{name} AS (
  SELECT key, 0 AS level, idx, n, d FROM {leaves}
  UNION ALL
  SELECT key, level + 1, idx // 2, (n + 1) // 2, sha256(string_agg(d, '' ORDER BY idx)) FROM {name} WHERE n > 1 GROUP BY key, level, idx // 2, n),
{name}_paths AS (
  SELECT a.key, a.idx, list(CASE WHEN s.d IS NULL THEN '{ALONE}' WHEN s.idx % 2 = 1 THEN '{RIGHT}' || s.d ELSE '{LEFT}' || s.d END
                            ORDER BY b.level) FILTER (b.n > 1) AS path
  FROM {leaves} a JOIN {name} b ON b.key = a.key AND b.idx = a.idx >> b.level
  LEFT JOIN {name} s ON s.key = b.key AND s.level = b.level AND s.idx = xor(b.idx, 1) GROUP BY a.key, a.idx)"""


ORACLE = f"""
WITH RECURSIVE docs AS (
  SELECT doc_id, coalesce('1' || lang, '0') AS key, {_sql_leaf("n_chars")} AS d,
         CASE WHEN {sql_crc32("coalesce(doc_id, 0)::VARCHAR")} % 7 = 0 AND doc_id IS NOT NULL THEN {_sql_leaf("(n_chars + 1)")} END AS changed FROM documents),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, d) - 1 AS idx, count(*) OVER (PARTITION BY key) AS n FROM docs),
{_sql_levels("low", "leaves")},
tops AS (
  SELECT '' AS key, key AS lang_key, row_number() OVER (ORDER BY encode(key)) - 1 AS idx, count(*) OVER () AS n, d FROM low WHERE n = 1),
{_sql_levels("high", "tops")},
proofs AS (
  SELECT l.doc_id, l.d AS leaf, l.changed, t.d AS subroot, r.d AS root,
         coalesce(p.path, []) || coalesce(q.path, []) AS path
  FROM leaves l JOIN low_paths p USING (key, idx) JOIN tops t ON t.lang_key = l.key JOIN high_paths q ON q.idx = t.idx
  JOIN high r ON r.n = 1),
folded AS (
  SELECT *, list_reduce(list_prepend(coalesce(changed, leaf), path),
                        lambda d, e: sha256(CASE WHEN e[1] = '{LEFT}' THEN e[2:] || d ELSE d || e[2:] END)) AS folded_root FROM proofs)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda e: e[2:]), '')) AS proof_sha256,
       folded_root, folded_root = root AS verified
FROM folded
"""

ORACLES = {"op12_merkle_manifest": ORACLE}
QUERIES = {"op12_merkle_manifest": query}
