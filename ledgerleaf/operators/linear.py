"""Logistic regression on TF-IDF vectors with Spark ML."""

from __future__ import annotations

import warnings
from concurrent.futures import ThreadPoolExecutor
from functools import cached_property
from threading import Condition

from pyspark.ml.classification import LogisticRegression, OneVsRest
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerleaf.config import CategorizerConfig
from ledgerleaf.plans.storage import new_path

#: Vector entries a task sums in one step of a fit.  Steps over fewer entries take longer to start than to run.
TASK_ENTRIES = 2_000_000
#: Every task of a step sends a whole gradient, so there are no more than so many to a core, unless one had more entries than this.
TASKS_A_CORE, MOST_ENTRIES = 3, 50_000_000
#: Gradients are added on the cluster in so many levels; the driver gets the few sums of the last one.
LEVELS = 4
#: Coefficients that all fits running at once may have; the driver holds some thirty times as many numbers.
COEFFICIENTS_AT_ONCE = 1_000_000


def tasks_for(entries: int, cores: int) -> int:
    wanted = 1 + entries // TASK_ENTRIES
    return max(min(wanted, TASKS_A_CORE * cores), 1 + entries // MOST_ENTRIES)


class Vectors:
    """Stored rows (row_id, label, coarse, features), one folder per bucket, so that a bucket's fit reads its own rows only.

    The folders have the layout of the vector type, so all fits share one table that outlives lost executors.
    """

    def __init__(self, rows: DataFrame, buckets: list[str], n_features: int, *, columns: tuple = ("row_id", "label", "coarse"),
                 bucket: str = "coarse"):
        """``rows`` has ``features`` as ``features.vectorize`` gives them."""
        self.spark, self.buckets, self.n_features = rows.sparkSession, list(buckets), n_features
        self.path = new_path(self.spark, "vectors")
        number = F.array_position(F.array(*[F.lit(b) for b in self.buckets]), F.col(bucket)).cast("int")
        laid_out = rows.select(
            *columns, F.struct(F.lit(0).cast("byte").alias("type"), F.lit(n_features).alias("size"),
                               F.col("features.indices").alias("indices"), F.col("features.values").alias("values")).alias("features"),
            number.alias("__bucket"))
        laid_out.write.partitionBy("__bucket").parquet(self.path)
        self.schema = laid_out.schema

    def _read(self, schema: T.StructType, bucket: str | None) -> DataFrame:
        table = self.spark.read.schema(schema).parquet(self.path)
        if bucket is not None:
            table = table.where(F.col("__bucket") == self.buckets.index(bucket) + 1)
        return table.drop("__bucket")

    def arrays(self, bucket: str | None = None) -> DataFrame:
        """Rows with ``features`` as plain arrays."""
        return self._read(self.schema, bucket)

    @cached_property
    def entries(self) -> dict[str, int]:
        """Vector entries of each bucket."""
        found = self.spark.read.schema(self.schema).parquet(self.path).groupBy("__bucket").agg(
            F.sum(F.size("features.indices")).alias("n")).collect()
        return {self.buckets[r["__bucket"] - 1]: r["n"] for r in found}

    def vectors(self, bucket: str | None = None) -> DataFrame:
        """Rows with ``features`` as vectors, in as many partitions as its entries are worth."""
        fields = [T.StructField("features", VectorUDT()) if f.name == "features" else f for f in self.schema.fields]
        entries = sum(n for b, n in self.entries.items() if bucket in (None, b))
        return self._read(T.StructType(fields), bucket).coalesce(self._tasks(entries))

    def _tasks(self, entries: int) -> int:
        return tasks_for(entries, self.spark.sparkContext.defaultParallelism)

    def in_pieces(self, piece: Column, n: int) -> DataFrame:
        """``arrays`` stored anew in one folder per ``piece`` (0 to n - 1), whose number is ``__piece``."""
        path = new_path(self.spark, "pieces")
        rows = self.arrays().withColumn("__piece", piece)
        # no shuffle: a task writes its part of each piece
        rows.coalesce(self._tasks(sum(self.entries.values()))).write.partitionBy("__piece").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def values(self, *columns: str) -> DataFrame:
        """(*columns, idx, value), one row per known term of a row."""
        entries = F.explode(F.arrays_zip("features.indices", "features.values")).alias("e")
        return self.arrays().select(*columns, entries).select(*columns, F.col("e.indices").alias("idx"), F.col("e.values").alias("value"))


def _indexed(table: DataFrame, label: str, classes: list[str]) -> DataFrame:
    position = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label)) - 1
    return table.withColumn("__y", position.cast("double"))


def _ended(model, cfg: CategorizerConfig, what: str):
    """Warn when the iteration limit and not the tolerance ended a fit."""
    if model.hasSummary and model.summary.totalIterations >= cfg.max_iter:
        warnings.warn(f"the fit of {what} stopped at max_iter={cfg.max_iter} before it converged", stacklevel=3)
    return model


def fit_softmax(table: DataFrame, label: str, classes: list[str], cfg: CategorizerConfig, tol: float | None = None):
    """Multinomial fit with balanced weights; (class x feature coefficients, intercepts).

    Balanced weights sum to n, and the library averages losses where the penalty
    is stated for their sum: hence 1 / (C * n).  Two classes get two opposite rows, which together carry
    half the penalty of the single row of a binary fit: hence twice that.
    """
    counts = {r["label"]: r["n"] for r in
              table.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n")).collect()}
    n = sum(counts.values())
    pairs = [F.lit(x) for c in classes for x in (c, n / (len(classes) * counts[c]))]
    data = _indexed(table, label, classes).withColumn("__w", F.element_at(F.create_map(*pairs), F.col(label)))
    model = LogisticRegression(
        family="multinomial", featuresCol="features", labelCol="__y", weightCol="__w", standardization=False,
        regParam=(2.0 if len(classes) == 2 else 1.0) / (cfg.inverse_regularisation * n),
        maxIter=cfg.max_iter, tol=cfg.fine_tol if tol is None else tol, aggregationDepth=LEVELS,
    ).fit(data)
    _ended(model, cfg, f"{label} ({len(classes)} classes)")
    return model.coefficientMatrix.toArray(), [float(x) for x in model.interceptVector.toArray()]


def fit_one_vs_rest(table: DataFrame, label: str, classes: list[str], cfg: CategorizerConfig):
    """One binary fit per class; up to three run at once, as far as the driver can hold their coefficients."""
    first = table.select("features").first()
    at_once = max(1, min(3, COEFFICIENTS_AT_ONCE // max(first.features.size, 1))) if first else 1
    base = LogisticRegression(standardization=False, regParam=cfg.ovr_reg_param, maxIter=cfg.max_iter, tol=cfg.coarse_tol,
                              aggregationDepth=LEVELS)
    model = OneVsRest(classifier=base, featuresCol="features", labelCol="__y", parallelism=at_once).fit(
        _indexed(table, label, classes))
    return [m.coefficients.toArray() for m in model.models], [float(m.intercept) for m in model.models]


def fit_many(jobs: list, sizes: list[int], workers: int = 6) -> list:
    """Run independent fits with overlapping Spark jobs, as many at once as keep ``COEFFICIENTS_AT_ONCE``.

    ``sizes`` are the numbers of coefficients; a fit beyond the limit runs alone.
    """
    free, room = [COEFFICIENTS_AT_ONCE], Condition()

    def run(job, size):
        size = min(size, COEFFICIENTS_AT_ONCE)
        with room:
            room.wait_for(lambda: free[0] >= size)
            free[0] -= size
        try:
            return job()
        finally:
            with room:
                free[0] += size
                room.notify_all()

    with ThreadPoolExecutor(max_workers=workers) as pool:
        return [f.result() for f in [pool.submit(run, *x) for x in zip(jobs, sizes, strict=True)]]
