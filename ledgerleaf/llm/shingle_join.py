"""N-gram Jaccard join: a size-aware heavy-light join of shingle sets.

Documents are sets of hashed word shingles; two are linked when ``4 * shared >= 3 * union`` (0.75).  Equal sets become one
class first.  Then sets meet in lists under keys that linked sets must share:

* Small sets (up to a boundary) enumerate all their subsets of the size that a partner must share with them.
* Large sets scan inverted lists of single shingles.  In the order of rising frequency, two linked sets share one of
  the first ``n - ceil(0.75 n) + 1`` shingles; a pair is dropped when the shingles in front of the meeting place already
  outnumber the difference that 0.75 allows.  Shingles that are frequent in the corpus stand last in this
  order, so passages that many documents hold make no list unless a document consists of them.

The boundary is the size at which the cost of enumerating (subsets) meets that of scanning (list lengths), by the counts of
the data.  Any order of shingles gives the same links; the frequencies only make lists short.

Shingles are 64-bit hashes of words' 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerleaf.llm.common import Stored, read
from ledgerleaf.llm.components import by_ids, label, link_lists
from ledgerleaf.llm.pretokens import _weights
from ledgerleaf.plans.storage import materialise

WORDS, SHARED, UNION = 5, 3, 4
#: Shingles that keep their frequency for the order, the most frequent ones; counted in chunks of CHUNK shingles.
HEAVY, CHUNK, HEAVY_IN_CHUNK = 100_000, 4_000_000, 3
LARGEST_SMALL = 12
BATCH_CHARS = 2_000_000


def need(a: int, b: int) -> int:
    """Shingles that two linked sets of these sizes share at least."""
    return -(-SHARED * (a + b) // (SHARED + UNION))


def prefix(n: int) -> int:
    return n - -(-SHARED * n // UNION) + 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


FACTORS = np.random.default_rng(5).integers(1, 2**64, 64, np.uint64) | np.uint64(1)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in a row, A-Z in lower case, and how many words each text has."""
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
    sizes = np.fromiter(map(len, raw), np.int64, len(raw)) + 1
    blank = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
    upper = (data >= 0x41) & (data <= 0x5A)
    starts = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]])) if len(data) else np.empty(0, np.int64)
    counts = np.diff(np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes)])))
    if not len(starts):
        return np.empty(0, np.uint64), counts
    ends = np.flatnonzero(~blank & np.concatenate([blank[1:], [True]])) + 1
    lengths = ends - starts
    letters = np.flatnonzero(~blank)
    begin = np.cumsum(lengths) - lengths
    offset = np.arange(len(letters)) - np.repeat(begin, lengths)
    value = (data[letters] + (upper[letters] * np.uint8(32)) + np.uint16(1)).astype(np.uint64)
    return _mix(np.add.reduceat(_weights(int(lengths.max()))[offset] * value, begin)), counts


def shingle_sets(texts: list[str], words: int = WORDS) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each text; fewer words than a shingle has make one shingle, none make none."""
    hashes, counts = word_hashes(texts)
    joined = np.zeros(max(len(hashes) - words + 1, 0), np.uint64)
    for k in range(words):
        joined += hashes[k: k + len(joined)] * FACTORS[k]
    joined = _mix(joined)
    at = 0
    for n in counts.tolist():
        if n >= words:
            yield np.unique(joined[at: at + n - words + 1])
        elif n:
            yield _mix((hashes[at: at + n] * FACTORS[:n]).sum(keepdims=True) + np.uint64(n))
        else:
            yield np.empty(0, np.uint64)
        at += n


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) of about BATCH_CHARS characters."""
    ids, texts, size = [], [], 0
    for batch in batches:
        column = batch.column("text")
        for i, key in enumerate(batch.column("id").to_pylist()):
            text = column[i].as_py() or ""
            ids.append(key)
            texts.append(text)
            size += len(text)
            if size >= BATCH_CHARS:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _rows(names: str, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], names.split())


def _survey(docs: DataFrame, words: int) -> DataFrame:
    """One pass over the texts: (id, n, x, y) per document, with two set hashes, and (null, -1, shingle, count) of
    shingles that are frequent in a chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def frequent() -> pa.RecordBatch:
            found, counts = np.unique(np.concatenate(held), return_counts=True)
            keep = counts >= HEAVY_IN_CHUNK
            k = int(keep.sum())
            return _rows("id n x y", pa.nulls(k, pa.int64()), np.full(k, -1, np.int32), found[keep].view(np.int64), counts[keep])

        for ids, texts in _batches(batches):
            sets = list(shingle_sets(texts, words))
            n = np.fromiter(map(len, sets), np.int32, len(sets))
            x = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
            y = np.array([(s * FACTORS[7] ^ (s >> np.uint64(29))).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
            yield _rows("id n x y", pa.array(ids, pa.int64()), n, x, y)
            held += sets
            size += int(n.sum())
            if size >= CHUNK:
                yield frequent()
                held, size = [], 0
        if held:
            yield frequent()

    return materialise(docs.mapInArrow(run, "id long, n int, x long, y long"))


def _heavy(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(shingles in order, their counts) of at most HEAVY shingles, the most frequent of the corpus."""
    sums = materialise(counts.groupBy("x").agg(F.sum("y").alias("n")))
    level = F.floor(F.log2("n") * 8).cast("int")
    bins = sorted(((r.level, r["count"]) for r in sums.groupBy(level.alias("level")).count().collect()), reverse=True)
    least, held = 10**6, 0  # at most 8 * 63 bins
    for bin_level, n in bins:
        held += n
        if held > HEAVY:
            break
        least = bin_level
    rows = sums.where(level >= least).toPandas() if held else None
    if rows is None or rows.empty:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    shingles, n = rows["x"].to_numpy().view(np.uint64), rows["n"].to_numpy()
    order = np.argsort(shingles)
    return shingles[order], n[order]


def subsets(n: int, boundary: int) -> list[tuple[int, int, int]]:
    """(shared, smaller size, larger size) for which a small set of ``n`` shingles enumerates subsets."""
    return [(need(n, m), min(n, m), max(n, m)) for m in range(1, boundary + 1)
            if UNION * min(n, m) >= SHARED * max(n, m) and need(n, m) <= min(n, m)]


def choose_boundary(sizes: dict[int, int], list_length: float) -> int:
    """The boundary at which enumerating small sets and scanning for the others costs least together.

    ``sizes`` counts the sets of each size up to LARGEST_SMALL; ``list_length`` is how many sets a shingle's list holds.
    """
    def cost(boundary: int) -> float:
        small = sum(sizes.get(n, 0) * sum(comb(n, c) for c, _, _ in subsets(n, boundary)) for n in range(1, boundary + 1))
        return small + sum(sizes.get(n, 0) * prefix(n) * list_length for n in range(boundary + 1, LARGEST_SMALL + 1))

    return min(range(LARGEST_SMALL + 1), key=cost)


def _lists(docs: DataFrame, words: int, heavy: tuple[np.ndarray, np.ndarray], boundary: int) -> Stored:
    """(key, id, n, place): one row for each key of each set that another set has too; place is -1 for subsets."""
    shared = docs.sparkSession.sparkContext.broadcast(heavy)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, weight = shared.value
        for ids, texts in _batches(batches):
            keys, owners, sizes, places = [], [], [], []
            for key, own in zip(ids, shingle_sets(texts, words), strict=True):
                n = len(own)
                if not n:
                    continue
                if n > boundary or UNION * n >= SHARED * (boundary + 1):
                    p = prefix(n)
                    if len(shingles):
                        at = np.minimum(np.searchsorted(shingles, own), len(shingles) - 1)
                        frequency = np.where(shingles[at] == own, weight[at], 0)
                        own_order = own[np.argsort(frequency, kind="stable")[:p]]
                    else:
                        own_order = own[:p]
                    keys.append(own_order)
                    places.append(np.arange(p, dtype=np.int32))
                    owners.append(np.full(p, key))
                    sizes.append(np.full(p, n, np.int32))
                if n <= boundary:
                    made = {_subset_key(own[list(chosen)], part) for part in subsets(n, boundary)
                            for chosen in combinations(range(n), part[0])}
                    keys.append(np.fromiter(made, np.uint64, len(made)))
                    places.append(np.full(len(made), -1, np.int32))
                    owners.append(np.full(len(made), key))
                    sizes.append(np.full(len(made), n, np.int32))
            if keys:
                yield _rows("key id n place", np.concatenate(keys).view(np.int64), np.concatenate(owners),
                            np.concatenate(sizes), np.concatenate(places))

    rows = docs.mapInArrow(run, "key long, id long, n int, place int")
    met = rows.withColumn("met", F.count(F.lit(1)).over(W.partitionBy("key"))).where("met > 1").drop("met")
    return Stored(met, "shingle-lists")


def _subset_key(chosen: np.ndarray, part: tuple[int, int, int]) -> int:
    mark = np.array(part, np.uint64)
    return int(_mix((chosen * FACTORS[: len(chosen)]).sum(keepdims=True) + (mark * FACTORS[20:23]).sum(keepdims=True))[0])


def link(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(id, n_shingles, component_id) of every row of ``docs``.

    ``component_id`` is the smallest id that links reach, the row's own included.  Null and empty texts, and texts
    without words, have 0 shingles and are their own component; rows with a null id have a null one and link nothing.  Rows that share an id are one document: one of their
    texts (that with most shingles) decides.  Other columns are not looked at.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    survey = _survey(texts, words)
    rows = survey.where("n >= 0")
    chosen = rows.where("id is not null and n > 0").groupBy("id").agg(F.max(F.struct("n", "x", "y")).alias("s"))
    classes = materialise(chosen.groupBy("s").agg(F.min("id").alias("class"), F.count(F.lit(1)).alias("copies")))
    members = materialise(chosen.join(classes.select("s", "class"), "s").select("id", "class"))
    heavy = _heavy(survey.where("n < 0").select("x", "y"))
    few = classes.where(F.col("s.n") <= LARGEST_SMALL).groupBy(F.col("s.n").alias("n")).count().collect()
    total = classes.agg(F.sum("s.n")).first()[0] or 1
    boundary = choose_boundary({r.n: r["count"] for r in few}, 1 + float((heavy[1].astype(float) ** 2).sum()) / total)

    copies = members.where("id != class").select("id")
    own = by_ids(texts.where("id is not null"), copies, "id", "left_anti")
    lists = _lists(own, words, heavy, boundary)

    size = F.col("a_n") + F.col("b_n")
    least = F.ceil(SHARED * size / (SHARED + UNION) - 1e-9)
    subset = (F.col("a_place") < 0) & (F.col("b_place") < 0)
    scan = (F.col("a_place") >= 0) & (F.col("b_place") >= 0) & (F.greatest("a_n", "b_n") > boundary) & \
        (F.col("a_place") + F.col("b_place") <= size - 2 * least) & \
        (F.col("a_n") - F.col("a_place") >= least) & (F.col("b_n") - F.col("b_place") >= least)
    able = (UNION * F.least("a_n", "b_n") >= SHARED * F.greatest("a_n", "b_n")) & (subset | scan)

    # the shingles of a set's prefix that other sets have in theirs: a bound on what two sets share
    fronts = Stored(lists.df.where("place >= 0").groupBy("id").agg(F.collect_set("key").alias("front"), F.max("n").alias("n")), "fronts")

    def promising(pairs: DataFrame) -> DataFrame:
        """Pairs that can be linked by their fronts: what they share beyond lies behind the prefix of one of them."""
        sides = [fronts.df.select(F.col("id").alias(s), F.col("front").alias(f"{s}_front"), F.col("n").alias(f"{s}_n")) for s in "ab"]
        both = pairs.join(sides[0], "a", "left").join(sides[1], "b", "left")
        rest = F.greatest(*(F.ceil(SHARED * F.col(f"{s}_n") / UNION - 1e-9) - 1 for s in "ab"))
        most = F.size(F.array_intersect("a_front", "b_front")) + rest
        small = (F.greatest("a_n", "b_n") <= boundary) | F.col("a_n").isNull() | F.col("b_n").isNull()
        return both.where(small | (most >= least)).select("a", "b")

    def verify(pairs: DataFrame) -> DataFrame:
        pairs = materialise(promising(pairs))
        ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()

        def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for keys, own_texts in _batches(batches):
                made = list(shingle_sets(own_texts, words))
                flat = np.concatenate(made).view(np.int64) if made else np.empty(0, np.int64)
                ends = np.cumsum([0, *map(len, made)])
                yield _rows("id shingles", pa.array(keys, pa.int64()), pa.ListArray.from_arrays(
                    pa.array(ends, pa.int32()), pa.array(flat)))

        held = by_ids(own, ids, "id", "left_semi").mapInArrow(sets, "id long, shingles array<long>")
        # rows that share an id: the text that was chosen
        held = held.groupBy("id").agg(F.max_by("shingles", F.size("shingles")).alias("shingles"))
        sides = [held.select(F.col("id").alias(s), F.col("shingles").alias(f"{s}_set")) for s in "ab"]
        both = pairs.join(sides[0], "a").join(sides[1], "b")
        shared = F.size(F.array_intersect("a_set", "b_set"))
        union = F.size("a_set") + F.size("b_set") - shared
        return both.where(UNION * shared >= SHARED * union).select("a", "b")

    found = link_lists(lists.df, able, verify, ["place", "n"])
    lists.drop()
    fronts.drop()
    named = label(members.select(F.col("class").alias("id"), F.col("id").alias("member")), found)
    named = named.select(F.col("member").alias("id"), "component")
    return (rows.select("id", F.col("n").cast("long").alias("n_shingles")).join(named, "id", "left")
            .select("id", "n_shingles", F.coalesce("component", "id").alias("component_id")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document."""
    linked = link(read(spark, sf_dir, "documents"))
    return linked.withColumnRenamed("id", "doc_id")


QUERIES = {"op3_shingle_join": query}
