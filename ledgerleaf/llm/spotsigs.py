"""SpotSigs fingerprints: chains of content words that follow common words.

Every occurrence of an anchor (a common word of one of four languages) gives a signature: the anchor and
the next ``chain`` content words, common words between them left out.  The set of a text's signatures is its
fingerprint; the likeness of two is the Jaccard index of the sets.

`near_duplicates` compares all texts: sets fall into partitions by length, so wide that two sets with a
likeness of ``threshold`` lie in one partition or in two beside each other; within these, sets meet on the
rarest signatures of each (prefix lists), and what length and place rule out is dropped before sets are compared.

Only DataFrame functions are used; signatures come from one regular expression a text.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import groupby

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerleaf.llm.common import read
from ledgerleaf.plans.storage import materialise

ANCHORS = {
    "en": "a and for in is of on that the to was with",
    "fr": "de des en est et la le les pour que un une",
    "de": "das den der die ein ist mit und von zu",
    "es": "con de del el en la los por que se un y",
}
CHAIN = 3
BUCKET_ROWS, MAX_BUCKETS = 4_096, 65_536
LOWEST = -(1 << 63)


def alternatives(words: list[str]) -> str:
    """A pattern of the words that branches letter by letter, so that few branches are tried at each place."""
    rest = {w for w in words if w}
    branches = [first + alternatives([w[1:] for w in group]) for first, group in groupby(sorted(rest), lambda w: w[0])]
    joined = f"(?:{'|'.join(branches)})" if branches else ""
    return f"{joined}?" if joined and "" in words else joined


def _patterns(chain: int) -> tuple[str, str]:
    stop = alternatives([w for words in ANCHORS.values() for w in words.split()]) + r"(?![\p{L}\p{N}])"
    gap, word = r"[^\p{L}\p{N}]", r"[\p{L}\p{N}]"
    follow = f"(?:{gap}++(?:{stop}{gap}++)*+{word}++){{{chain}}}"
    find = f"(?<!{word})(?=({stop}{follow})){stop}"
    inner = r"[^\p{L}\p{N}\x01]++(?:" + stop + r"[^\p{L}\p{N}\x01]++)*+"
    return find, inner


def _with(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), then), 1)


def signatures(text: Column, chain: int = CHAIN, wide: bool = False) -> Column:
    """Sorted distinct signatures of a text as 32-bit numbers (long), or with ``wide`` as 64-bit numbers.

    A text with words but without a chain is its own only signature; a text without words, or null, has none.
    """
    find, inner = _patterns(chain)

    def of(low: Column) -> Column:
        found = F.array_join(F.regexp_extract_all(low, F.lit(find), F.lit(1)), "\x01")
        return _with(found, lambda x: F.when(x != "", F.split(F.regexp_replace(x, inner, " "), "\x01"))
                     .when(low.rlike(r"[\p{L}\p{N}]"), F.array(low)).otherwise(F.array().cast("array<string>")))

    chains = _with(F.lower(F.coalesce(text, F.lit(""))), of)
    number = lambda x: F.xxhash64(x) if wide else F.crc32(x.cast("binary"))
    return F.array_sort(F.array_distinct(F.transform(chains, number)))


def fingerprint(sigs: Column) -> Column:
    return F.array_join(F.transform(sigs, lambda x: F.lower(F.hex(x))), ",")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard index of two sets; 1 for two empty ones.  Sets of which one is empty are not intersected."""
    shared = F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0)).otherwise(F.size(F.array_intersect(a, b)))
    union = F.size(a) + F.size(b) - shared
    return F.when(union == 0, F.lit(1.0)).otherwise(shared / union)


def length_partition(size: Column, threshold: float) -> Column:
    """Sets with a likeness of ``threshold`` have lengths whose quotient is at least that."""
    return F.when(size > 0, F.floor(F.log(size) / -math.log(threshold) + 1e-9)).otherwise(F.lit(-1)).cast("long")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.75,
                    chain: int = CHAIN) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): (id, class_id) of every row, and (a, b, likeness) of classes with at least ``threshold``.

    Rows with equal fingerprints are one class, named by its smallest id; texts without words are in none (null).  Pairs
    hold a < b and are complete between classes.  Rows without an id take no part.
    """
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), signatures(F.col(text_col), chain, wide=True).alias("sigs"))
    rows = materialise(rows.withColumn("key", F.sha2(fingerprint(F.col("sigs")), 256)))
    classes = rows.where(F.size("sigs") > 0).groupBy("key").agg(F.min("id").alias("class_id"), F.first("sigs").alias("sigs"))
    classes = materialise(classes)
    members = rows.select("id", "key").join(classes.select("key", "class_id"), "key", "left").select("id", "class_id")

    spread = classes.select("class_id", F.size("sigs").alias("n"), F.explode("sigs").alias("sig"))
    counts = spread.groupBy("sig").agg(F.count(F.lit(1)).alias("df")).where("df > 1")  # others have no partner
    rare = W.partitionBy("class_id").orderBy("df", "sig")
    shared = spread.join(counts, "sig").withColumn("place", F.row_number().over(rare))
    # signatures without a partner are the rarest and stand before the others
    alone = F.col("n") - F.count(F.lit(1)).over(W.partitionBy("class_id"))
    shared = shared.withColumn("place", F.col("place") + alone)
    prefix = shared.where(F.col("place") <= F.col("n") - F.ceil(threshold * F.col("n") - 1e-9) + 1) \
        .withColumn("part", length_partition(F.col("n"), threshold))
    left = prefix.select("sig", F.col("class_id").alias("a"), F.col("n").alias("na"), F.col("place").alias("pa"),
                         F.explode(F.array(F.col("part"), F.col("part") + 1)).alias("part"))
    right = prefix.select("sig", F.col("class_id").alias("b"), F.col("n").alias("nb"), F.col("place").alias("pb"), "part")
    need = threshold / (1 + threshold) * (F.col("na") + F.col("nb")) - 1e-9
    left_over = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) + 1 + F.least("pa", "pb") - 1
    order = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    met = left.join(right, ["sig", "part"]).where(order & (left_over >= need)).select("a", "b").distinct()
    sets = classes.select("class_id", "sigs")
    pairs = (met.join(sets.select(F.col("class_id").alias("a"), F.col("sigs").alias("sa")), "a")
             .join(sets.select(F.col("class_id").alias("b"), F.col("sigs").alias("sb")), "b")
             .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), likeness(F.col("sa"), F.col("sb")).alias("likeness")))
    return members, pairs.where(F.col("likeness") >= threshold - 1e-12)


def _bucket(key: Column, bounds: list[int]) -> Column:
    """How many bounds lie below the key: first among every k-th bound, then among the k behind it."""
    if not bounds:
        return F.lit(0)
    step = math.isqrt(len(bounds)) + 1
    heads = F.array(*(F.lit(b) for b in bounds[::step]))
    groups = F.array(*(F.array(*(F.lit(b) for b in bounds[i: i + step])) for i in range(0, len(bounds), step)))
    below = lambda array: F.size(F.filter(array, lambda b: b < key))
    head = below(heads)
    return F.when(head == 0, F.lit(0)).otherwise((head - 1) * step + below(F.element_at(groups, F.greatest(head, F.lit(1)))))


def with_next(docs: DataFrame, columns: list[str], *, id_col: str = "doc_id", bucket_rows: int = BUCKET_ROWS,
              derived: dict[str, Column] | None = None) -> DataFrame:
    """``docs`` with __next_<column> of the next row in descending order of the id; the last row's next is the first.

    ``derived`` are columns made from ``columns``; they are added, once for every row, and have a __next_ too.

    The ids alone give bounds of about ``bucket_rows`` rows.  A bucket also gets the first row of the following
    one, so each is ordered by itself and rows are shuffled once.  A null id comes last; rows that share an id follow
    each other by the hash of their columns.
    """
    keyed = docs.withColumn("__id", F.coalesce(F.col(id_col).cast("long"), F.lit(LOWEST)))
    buckets = min(MAX_BUCKETS, -(-keyed.count() // bucket_rows))
    bounds: list[int] = []
    if buckets > 1:
        at = [i / buckets for i in range(1, buckets)]
        bounds = sorted(set(keyed.agg(F.percentile_approx("__id", at, min(10 * buckets, 1_000_000))).first()[0]))
    keyed = keyed.withColumns({"__bucket": _bucket(F.col("__id"), bounds), "__tie": F.xxhash64(*columns)})
    # at most MAX_BUCKETS + 1 rows
    heads = sorted(((r.b, r.first) for r in keyed.groupBy(F.col("__bucket").alias("b")).agg(F.max("__id").alias("first")).collect()),
                   reverse=True)
    follows = [(b, heads[(i + 1) % len(heads)][1]) for i, (b, _) in enumerate(heads)]
    guests = docs.sparkSession.createDataFrame(follows, "__bucket int, __id long")
    value = F.struct("__tie", *(F.col(c) for c in columns))
    guests = keyed.drop("__bucket").join(F.broadcast(guests), "__id").groupBy("__id", "__bucket").agg(F.min(value).alias("x")) \
        .select("__bucket", F.lit(True).alias("__guest"), *(F.col(f"x.{c}").alias(c) for c in columns))
    # derived columns come last, so that they are computed for the few guests and not for all rows these are chosen from
    derived = derived or {}
    rows = keyed.withColumn("__guest", F.lit(False)).withColumns(derived).unionByName(guests.withColumns(derived), allowMissingColumns=True)
    order = W.partitionBy("__bucket").orderBy("__guest", F.desc("__id"), "__tie")
    rows = rows.withColumns({f"__next_{c}": F.lead(c).over(order) for c in [*columns, *derived]})
    return rows.where(~F.col("__guest")).drop("__guest", "__id", "__bucket", "__tie")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(docs, ["text"], derived={"sigs": signatures(F.col("text"), wide=True)})
    n = F.length("text").cast("long")
    swap = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n.cast("int") - swap), F.substring("__next_text", F.lit(1), swap))
    rows = rows.select("doc_id", n.alias("n_chars"), "sigs", "__next_sigs", edited.alias("edited"))
    rows = rows.withColumn("edited_sigs", signatures(F.col("edited"), wide=True))
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("sigs")).alias("fingerprint"), fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"),
        likeness(F.col("sigs"), F.col("__next_sigs")).alias("near_next"))


QUERIES = {"op9_spotsigs": query}
