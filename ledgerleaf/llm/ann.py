"""Approximate nearest neighbours with learned partitions.

1. A sample (``SAMPLE`` vectors at most, by hash of the id) gives a neighbour graph.
2. The graph is cut into balanced parts: median splits along principal directions, then moves of single vectors that
   cut fewer edges, as long as no part outgrows the mean by ``SLACK``.
3. A softmax classifier learns, for each vector, how its neighbours are spread over the parts.
4. Every row goes to its most probable part.  A query visits its ``probes`` most probable parts, and their rows are ranked by
   the exact cosine.  ``probes`` is the smallest number that finds ``RECALL`` of the sample's own neighbours.

Rows of a part are dealt over blocks of about ``BLOCK_ROWS``, so a vector that a third of all rows hold makes more
blocks, not a larger one.  Only the sample, the classifier and the sizes of the parts reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerleaf.llm.common import read, uniform
from ledgerleaf.plans.storage import materialise

SAMPLE, ROWS_PER_PART, MAX_PARTS = 8_192, 512, 256
NEIGHBOURS, SLACK, RECALL = 10, 0.05, 0.95
BLOCK_ROWS, QUERY_ROWS, SLAB = 8_192, 2_048, 256


def balanced_parts(graph: np.ndarray, x: np.ndarray, parts: int, passes: int = 12) -> np.ndarray:
    """Part of each vector; ``graph`` holds the neighbours of each, ``parts`` the number of parts."""
    part = np.zeros(len(x), np.int64)

    def split(rows: np.ndarray, first: int, count: int) -> None:
        if count == 1:
            part[rows] = first
            return
        centred = x[rows] - x[rows].mean(0)
        axis = np.linalg.eigh(centred.T @ centred)[1][:, -1]
        order = rows[np.argsort(centred @ axis, kind="stable")]
        half = count // 2
        cut = len(rows) * half // count
        split(order[:cut], first, half)
        split(order[cut:], first + half, count - half)

    split(np.arange(len(x)), 0, parts)
    limit = int(np.ceil(len(x) / parts * (1 + SLACK)))
    floor = int(len(x) / parts * (1 - SLACK))
    size = np.bincount(part, minlength=parts)
    back = [[] for _ in range(len(x))]  # edges count in both directions
    for i, own in enumerate(graph.tolist()):
        for j in own:
            back[j].append(i)
    near = [np.array([*graph[i].tolist(), *back[i]]) for i in range(len(x))]
    for _ in range(passes):
        moved = 0
        for i in range(len(x)):
            counts = np.bincount(part[near[i]], minlength=parts)
            counts[size >= limit] = -1
            best, now = int(counts.argmax()), part[i]
            if counts[best] > np.count_nonzero(part[near[i]] == now) and size[now] > floor:
                size[now] -= 1
                size[best] += 1
                part[i] = best
                moved += 1
        if not moved:
            break
    return part


def fit_softmax(x: np.ndarray, target: np.ndarray, rounds: int = 300, rate: float = 0.05, decay: float = 1e-4) -> np.ndarray:
    """Weights (dimensions + 1, parts) of a softmax classifier for soft targets, by Adam over the whole sample."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros((x.shape[1], target.shape[1]))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        g = x.T @ (_softmax(x @ w) - target) / len(x) + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return w


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


@dataclass
class Router:
    weights: np.ndarray
    probes: int

    @property
    def parts(self) -> int:
        return self.weights.shape[1]

    def ranked(self, x: np.ndarray) -> np.ndarray:
        """Parts of each vector, the most probable first."""
        unit = x / np.linalg.norm(x, axis=1)[:, None]
        return np.argsort(-(unit @ self.weights[:-1] + self.weights[-1]), axis=1, kind="stable")


def fit_router(sample: np.ndarray, parts: int, k: int, recall: float = RECALL) -> Router:
    unit = sample / np.linalg.norm(sample, axis=1)[:, None]
    n = len(unit)
    many = min(NEIGHBOURS, n - 1)
    if parts <= 1 or many < 1:
        return Router(np.zeros((sample.shape[1] + 1, 1)), 1)
    graph = np.empty((n, many), np.int64)
    for a in range(0, n, 1024):
        near = unit[a: a + 1024] @ unit.T
        near[np.arange(len(near)), np.arange(a, a + len(near))] = -np.inf
        found = np.argpartition(-near, many - 1, axis=1)[:, :many]
        graph[a: a + 1024] = np.take_along_axis(found, np.argsort(-np.take_along_axis(near, found, 1), axis=1, kind="stable"), 1)
    part = balanced_parts(graph, unit, parts)
    target = np.zeros((n, parts))
    np.add.at(target, (np.repeat(np.arange(n), many), part[graph].ravel()), 1)
    np.add.at(target, (np.arange(n), part), 1)
    router = Router(fit_softmax(unit, target / (many + 1)), parts)
    order = router.ranked(sample)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(parts)[None, :], 1)
    visit = np.sort(np.take_along_axis(place, order[:, 0][graph[:, :k]], 1).ravel())
    router.probes = int(visit[min(len(visit) - 1, int(np.ceil(recall * len(visit))) - 1)]) + 1
    return router


def usable(vector: Column) -> Column:
    """Whether a vector has a direction: components all there and finite, not all zero."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return vector.isNotNull() & F.forall(vector, fine) & F.exists(vector, lambda x: x != 0)


def _matrix(column: pa.ChunkedArray | pa.Array, dimensions: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), float).reshape(-1, dimensions)


def _as_bytes(x: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in np.ascontiguousarray(x)], pa.binary())


def nearest(queries: DataFrame, rows: DataFrame, *, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
            recall: float = RECALL, rows_per_part: int = ROWS_PER_PART, sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows of largest cosine found for each query, its own id left out.

    Vectors that are null, zero or hold null or non-finite components take no part, nor do rows without an id or of
    another length than most.  Ties go to the smaller id.  A query gets fewer than ``k`` rows only if there are
    fewer.  Repeated rows are each a candidate; a repeated query is asked once, and vectors that share an id are
    queries of their own, each with its ranks.  Other columns are not looked at; an empty table gives an empty result.
    """
    spark = rows.sparkSession
    tidy = lambda df: df.where(F.col(id_col).isNotNull() & usable(F.col(vector_col))).select(
        F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows, queries = tidy(rows), tidy(queries).distinct()
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if lengths is None:
        return spark.createDataFrame([], schema)
    d, n = int(lengths.d), int(lengths["count"])
    rows, queries = rows.where(F.size("v") == d), queries.where(F.size("v") == d)
    chance = min(1.0, sample / n)
    drawn = rows.where(uniform(F.col("id"), seed=2) <= chance * 1.2).orderBy(F.xxhash64("id"), "id").limit(sample)
    points = np.array([r.v for r in drawn.select("v").collect()]).reshape(-1, d)
    parts = max(1, min(MAX_PARTS, n // rows_per_part, len(points) // 32)) if n >= 4 * rows_per_part else max(1, min(4, n // 32))
    router = fit_router(points, parts, k, recall)
    shared = spark.sparkContext.broadcast(router)

    def assign(batches):
        for batch in batches:
            x = np.array(batch.column("v").to_pylist(), float).reshape(-1, d)
            yield pa.RecordBatch.from_arrays([batch.column("id"), _as_bytes(x), pa.array(
                shared.value.ranked(x)[:, 0].astype(np.int32))], ["id", "v", "part"])

    index = materialise(rows.mapInArrow(assign, "id long, v binary, part int"))
    sizes = {r.part: r["count"] for r in index.groupBy("part").count().collect()}  # MAX_PARTS rows at most
    small = sorted(sizes.get(p, 0) for p in range(router.parts))
    probes = router.probes
    while probes < router.parts and sum(small[:probes]) <= k:
        probes += 1
    blocks = [max(1, -(-sizes.get(p, 0) // BLOCK_ROWS)) for p in range(router.parts)]
    groups = max(1, -(-queries.count() // QUERY_ROWS))

    def route(batches):
        for batch in batches:
            x = np.array(batch.column("v").to_pylist(), float).reshape(-1, d)
            visits = [(i, p, b) for i, own in enumerate(shared.value.ranked(x)[:, :probes].tolist())
                      for p in own for b in range(blocks[p])]
            if visits:
                at, part, block = (np.array(c, np.int32) for c in zip(*visits, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at)), _as_bytes(x).take(pa.array(at)),
                                                  pa.array(part), pa.array(block)], ["id", "v", "part", "block"])

    deal = lambda c, m: F.pmod(F.xxhash64(c), m).cast("int")
    asked = queries.mapInArrow(route, "id long, v binary, part int, block int").withColumn("turn", deal("id", F.lit(groups)))
    in_part = F.element_at(F.array(*map(F.lit, blocks)), F.col("part") + 1)
    held = index.withColumn("block", F.pmod(F.xxhash64("id"), in_part).cast("int")) \
        .withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def rank(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, q_ids = right.column("id").to_numpy(), left.column("id").to_numpy()
        vectors = [xxhash.xxh3_64_intdigest(v) >> 1 for v in left.column("v").to_pylist()]
        out: list[tuple[np.ndarray, ...]] = []
        if len(ids) and len(q_ids):
            c, q = _matrix(right.column("v"), d), _matrix(left.column("v"), d)
            c_norm, q_norm = np.sqrt((c * c).sum(1)), np.sqrt((q * q).sum(1))
            unit = (c / c_norm[:, None]).T
            for a in range(0, len(q), SLAB):
                near = (q[a: a + SLAB] / q_norm[a: a + SLAB, None]) @ unit
                for i, row in enumerate(near, a):
                    row[ids == q_ids[i]] = -np.inf
                    low = np.partition(row, -k)[-k] if len(row) >= k else -np.inf
                    at = np.flatnonzero(row >= max(low - 1e-9, -2))
                    # equal vectors get equal scores: each pair is summed in the same order
                    score = (c[at] * q[i]).sum(1) / (c_norm[at] * q_norm[i])
                    best = np.lexsort((ids[at], -score))[:k]
                    out.append((np.full(len(best), q_ids[i]), np.full(len(best), vectors[i], np.int64), ids[at][best], score[best]))
        columns = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.empty(0, np.int64)] * 3 + [np.empty(0)]
        return pa.table(columns, ["query_id", "vector", "vec_id", "score"])

    keys = ["part", "block", "turn"]
    found = asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(rank, "query_id long, vector long, vec_id long, score double")
    order = W.partitionBy("query_id", "vector").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five nearest rows of every fiftieth vector."""
    rows = read(spark, sf_dir, "embeddings")
    return nearest(rows.where(F.col("vec_id") % 50 == 0), rows)


QUERIES = {"op2_nearest": query}
