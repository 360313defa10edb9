"""A trie of conversation prefixes by van Emde Boas recursion.

Sequences of turns are cut at half depth, the halves at half of that, and so on.  All pieces of a level are handled at
once, as one table of turns (sequence, depth, token, root), where ``root`` names the prefix that a piece hangs from:

* Down: the turns of a piece's upper half, summed by exclusive or, name the prefix at its cut; that name becomes the root of
  the lower half.  Pieces of height one are nodes: the root is the parent's name, root and turn together are its own.
* Up: pieces of one height are joined in pairs.  Each tree of a lower forest adds its totals to the nodes above its
  top in the upper piece, found along one sequence that passes the top.  After all heights every node has its whole subtree.

So both ways take log2(longest sequence) steps, and each row meets each step once.  Equal sequences are one from the
start, with their number and their smallest id.  Names are 128 bits; equal names count as equal prefixes.  Rows of a
long sequence are spread over tasks: names are sums, and joins by sequence can be split.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerleaf.llm.common import WORD, Stored, read, sql_crc32
from ledgerleaf.llm.positions import numbered
from ledgerleaf.operators.joins import join_skewed

SHARED_TURNS, SHARED_BY = 4, 20


def _name(*parts: Column, seeds: tuple[int, int] = (17, 43)) -> list[Column]:
    return [F.xxhash64(F.lit(seed), *parts) for seed in seeds]


def tokens(rows: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text") -> tuple[DataFrame, Stored]:
    """(id, idx, a, b, words): the hash of each turn's role and text, and its words; rows without an id take no part.

    Null roles and texts are empty.  Turns ascend, null first; rows that share a turn are ordered by their hash, and equal
    rows are turns of their own.
    """
    role, text = (F.coalesce(c, F.lit("")) for c in (role_col, text_col))
    a, b = _name(role, text)
    turns = rows.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.col(turn_col).alias("turn"), a.alias("a"), b.alias("b"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    placed, stored = numbered(turns, "id", ["turn", "a", "b"], "trie-turns")
    return placed.drop("turn"), stored


def shared(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(all ids, turns) of the conversations rebuilt on the first turns of the conversation that their group begins with."""
    ids = turns.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    heads = F.crc32(F.col("id").cast("string").cast("binary")) % SHARED_TURNS
    ids = ids.select("id", heads.alias("h"), (F.col("id") - F.col("id") % SHARED_BY).alias("base"))
    first = turns.where(F.col("idx") < SHARED_TURNS - 1).withColumnRenamed("id", "base")  # three rows an id at most
    taken = ids.where("h > 0").join(first, "base").where("idx < h")
    lent = taken.groupBy("id").agg(F.count(F.lit(1)).alias("k"))
    own = join_skewed(turns, ids.join(lent, "id", "left").select("id", "h", F.coalesce("k", F.lit(0)).alias("k")), "id", "inner",
                      spread_by="idx").where("idx >= h")
    moved = own.withColumn("idx", F.col("idx") - F.col("h") + F.col("k"))
    return ids.select("id"), taken.select(*turns.columns).unionByName(moved.select(*turns.columns))


def trie(ids: DataFrame, turns: DataFrame) -> tuple[DataFrame, DataFrame, list[Stored]]:
    """(nodes, ends) of ``turns`` (id, idx from 0, a, b, words) over all ``ids``.

    nodes: a, b (name), parent_a, parent_b (null for the root, whose name is 0, 0), depth, words, n_convs, low (smallest
    id), leaves and saved, the totals over its subtree.  ends: (id, a, b), the node at which an id ends.  Without
    ids there are no nodes.
    """
    place = turns.select("id", F.col("idx").alias("at"), "words", *(F.xxhash64(c, "idx").alias(c) for c in "ab"))
    turns_ = Stored(place, "trie-sequences")
    whole = turns_.df.groupBy("id").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    ends = Stored(ids.join(whole, "id", "left").select("id", F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b")),
                  "trie-ends")
    # equal sequences are one, told by the smallest id; those of no turns are the root alone
    once = ends.df.groupBy("a", "b").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")).select("id", "n")
    rows = turns_.df.join(once, "id").withColumns({"root_a": F.lit(0).cast("long"), "root_b": F.lit(0).cast("long")})
    rows = Stored(rows, "trie-rows")
    longest = rows.df.agg(F.max("at").alias("n")).first().n
    height = 1
    while longest is not None and height <= longest:
        height *= 2
    half = height // 2
    while half:  # down
        odd = F.floor(F.col("at") / half) % 2 == 1
        piece = F.floor(F.col("at") / (2 * half)).alias("piece")
        reaches = rows.df.where(odd & (F.col("at") % half == 0)).select("id", piece)  # sequences that go on after the cut
        cuts = rows.df.where(~odd).groupBy("id", piece).agg(F.bit_xor("a").alias("u"), F.bit_xor("b").alias("v")).join(reaches, ["id", "piece"])
        low = rows.df.where(odd).withColumn("piece", piece).join(cuts, ["id", "piece"]).withColumns(
            {"root_a": F.col("root_a").bitwiseXOR(F.col("u")), "root_b": F.col("root_b").bitwiseXOR(F.col("v"))})
        before, rows = rows, Stored(rows.df.where(~odd).unionByName(low.select(rows.df.columns)), "trie-rows")
        before.drop()
        half //= 2
    named = rows.df.withColumns({c: F.col(f"root_{c}").bitwiseXOR(F.col(c)) for c in "ab"})
    edges = named.groupBy("a", "b").agg(F.first("root_a").alias("parent_a"), F.first("root_b").alias("parent_b"), F.first("at").alias("at"),
                                        F.first("words").alias("words"), F.sum("n").alias("n_convs"), F.min("id").alias("low"))
    kids = edges.groupBy(F.col("parent_a").alias("a"), F.col("parent_b").alias("b")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = edges.join(kids, ["a", "b"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long"))
    nodes = nodes.withColumns({"leaves": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("words")})
    nodes = Stored(nodes, "trie-nodes")
    half = 1
    while half < height:  # up
        tops = nodes.df.where(F.col("at") % (2 * half) == half).select(
            F.col("low").alias("id"), F.floor(F.col("at") / half).alias("piece"), F.col("leaves").alias("x"), F.col("saved").alias("y"))
        # the turns just above a top along one sequence that passes it
        above = named.select("id", "a", "b", (F.floor(F.col("at") / half) + 1).alias("piece")).where("piece % 2 = 1")
        more = above.join(tops, ["id", "piece"]).groupBy("a", "b").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
        grown = nodes.df.join(more, ["a", "b"], "left").withColumns(
            {"leaves": F.col("leaves") + F.coalesce("x", F.lit(0)), "saved": F.col("saved") + F.coalesce("y", F.lit(0))}).drop("x", "y")
        before, nodes = nodes, Stored(grown, "trie-nodes")
        before.drop()
        half *= 2
    top = nodes.df.where("at = 0").agg(F.count(F.lit(1)).alias("n_children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")).first()
    all_ = ends.df.agg(F.count(F.lit(1)).alias("n_convs"), F.min("id").alias("low")).first()
    own = {"a": 0, "b": 0, "parent_a": None, "parent_b": None, "depth": 0, "words": 0, "n_convs": all_.n_convs, "low": all_.low,
           "n_children": top.n_children, "leaves": top.leaves or 1, "saved": top.saved or 0}
    root = ids.sparkSession.range(1 if all_.n_convs else 0).select(*(F.lit(v).cast("long").alias(c) for c, v in own.items()))
    found = nodes.df.withColumn("depth", F.col("at") + 1).select(root.columns).unionByName(root)
    return found, ends.df, [turns_, ends, rows, nodes]


def end_digests(ends: DataFrame) -> DataFrame:
    """(a, b, ends_sha256): the ids that end at a node, ascending and comma-joined, digested as they stream by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, state = None, None
        for batch in batches:
            out = []
            for a, b, i in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "id")), strict=True):
                if (a, b) != name:
                    if state is not None:
                        out.append((*name, state.hexdigest()))
                    name, state = (a, b), hashlib.sha256(str(i).encode())
                else:
                    state.update(f",{i}".encode())
            yield pack(out)
        if state is not None:
            yield pack([(*name, state.hexdigest())])

    def pack(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
        types = (pa.int64(), pa.int64(), pa.string())
        columns = zip(*rows, strict=True) if rows else ([], [], [])
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], ["a", "b", "ends_sha256"])

    rows = ends.select("a", "b", "id").repartition("a", "b").sortWithinPartitions("a", "b", "id")
    return rows.mapInArrow(run, "a long, b long, ends_sha256 string")


def report(nodes: DataFrame, ends: DataFrame) -> DataFrame:
    """Nodes by their smallest id and depth, with their parent's smallest id and the digest of the ids that end there."""
    parents = nodes.where("n_children > 0").select(F.struct("a", "b").alias("parent"), F.col("low").alias("parent_conv_id"))
    rows = nodes.withColumn("parent", F.struct(F.col("parent_a").alias("a"), F.col("parent_b").alias("b")))
    rows = join_skewed(rows, parents, "parent", "left", spread_by="low").join(end_digests(ends), ["a", "b"], "left")
    return rows.select(F.col("low").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children",
                       F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
                       F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, each rebuilt on the first turns of its group's first conversation."""
    turns, stored = tokens(read(spark, sf_dir, "conversations"))
    ids, rebuilt = shared(turns)
    nodes, ends, _ = trie(ids, rebuilt)
    return report(nodes, ends)


#: Paths are lists of hashes; a node's subtree is what its path begins.
ORACLE = f'''
WITH t AS (
  SELECT conv_id AS id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS idx,
         coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT DISTINCT id, id - id % {SHARED_BY} AS base, {sql_crc32("id::VARCHAR")} % {SHARED_TURNS} AS h FROM t),
taken AS (SELECT i.id, b.idx, b.role, b.text FROM ids i JOIN t b ON b.id = i.base AND b.idx < i.h),
lent AS (SELECT id, count(*) AS k FROM taken GROUP BY id),
rebuilt AS (
  SELECT * FROM taken UNION ALL
  SELECT t.id, t.idx - i.h + coalesce(l.k, 0), t.role, t.text FROM t JOIN ids i USING (id) LEFT JOIN lent l USING (id) WHERE t.idx >= i.h),
paths AS (
  SELECT id, idx + 1 AS depth, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words,
         list(md5(role || chr(0) || text)) OVER (PARTITION BY id ORDER BY idx) AS path
  FROM rebuilt),
members AS (SELECT id, depth, words, path FROM paths UNION ALL SELECT id, 0, 0, []::VARCHAR[] FROM ids),
nodes AS (SELECT path, depth, any_value(words) AS words, min(id) AS low, count(*) AS n FROM members GROUP BY path, depth),
last AS (SELECT id, max_by(path, depth) AS path FROM members GROUP BY id),
ends AS (SELECT path, string_agg(id::VARCHAR, ',' ORDER BY id) AS told FROM last GROUP BY path),
kids AS (SELECT path[:-2] AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
full_ AS (SELECT n.*, coalesce(k.n, 0) AS n_children FROM nodes n LEFT JOIN kids k USING (path)),
above AS (SELECT path[:d] AS path, (n_children = 0)::BIGINT AS leaf, (n - 1) * words AS saved
          FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM full_)),
totals AS (SELECT path, sum(leaf) AS leaves, sum(saved) AS saved FROM above GROUP BY path)
SELECT f.low AS conv_id, f.depth, p.low AS parent_conv_id, f.n AS n_convs, f.n_children, t.leaves::BIGINT AS n_leaves,
       t.saved::BIGINT AS saved_tokens, sha256(coalesce(e.told, '')) AS ends_sha256
FROM full_ f JOIN totals t USING (path) LEFT JOIN ends e USING (path)
LEFT JOIN nodes p ON f.depth > 0 AND p.path = f.path[:-2]
'''

ORACLES = {"op13_prefix_trie": ORACLE}
QUERIES = {"op13_prefix_trie": query}
