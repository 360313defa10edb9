"""Complement naive Bayes in closed form from stored vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HELD_SUMS = 2_000_000        # sums that a task holds


def _task_sums(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """(idx, k, s) of the rows of a task, a pair more than once when there are many."""
    keys, sums = np.zeros(0, np.int64), np.zeros(0)

    def batch_of(keys: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array((keys // width).astype(np.int32)), pa.array((keys % width).astype(np.int32)),
                                           pa.array(sums)], ["idx", "k", "s"])

    held = []
    for batch in batches:
        lists, k = batch.column("indices"), batch.column("k").to_numpy()
        key = lists.flatten().to_numpy().astype(np.int64) * width + k[lists.value_parent_indices().to_numpy()]
        key, at = np.unique(key, return_inverse=True)
        held.append((key, np.bincount(at, batch.column("values").flatten().to_numpy(), len(key))))
        if sum(len(x) for x, _ in held) > HELD_SUMS:
            key, at = np.unique(np.concatenate([keys, *(x for x, _ in held)]), return_inverse=True)
            keys, sums, held = key, np.bincount(at, np.concatenate([sums, *(x for _, x in held)]), len(key)), []
            if len(keys) > HELD_SUMS:
                yield batch_of(keys, sums)
                keys, sums = keys[:0], sums[:0]
    key, at = np.unique(np.concatenate([keys, *(x for x, _ in held)]), return_inverse=True)
    if len(key):
        yield batch_of(key, np.bincount(at, np.concatenate([sums, *(x for _, x in held)]), len(key)))


def class_sums(values: DataFrame, label: str, classes: list[str]) -> DataFrame:
    """(idx, sums): feature mass of each class, in the order of ``classes``; ``values`` has (label, idx, value) or
    (label, features) with both as arrays.

    One sum per (idx, class) whatever the number of classes.  Rows are partially summed before the shuffle, so a
    term that most rows hold reaches the reducer as one row per map task and class.
    """
    position = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label)).cast("int") - 1
    if "features" in values.columns:
        width = len(classes)
        rows = values.select("features.indices", "features.values", position.alias("k"))
        parts = rows.mapInArrow(lambda batches: _task_sums(batches, width), "idx int, k int, s double")
        sums = parts.groupBy("idx", "k").agg(F.sum("s").alias("s"))
    else:
        sums = values.select("idx", position.alias("k"), "value").groupBy("idx", "k").agg(F.sum("value").alias("s"))
    lists = sums.groupBy("idx").agg(F.collect_list(F.struct("k", "s")).alias("e"))
    width = len(classes)

    @F.arrow_udf("array<double>")
    def laid_out(e: pa.Array) -> pa.Array:
        out = np.zeros((len(e), width))
        flat = e.flatten()
        out[e.value_parent_indices().to_numpy(), flat.field("k").to_numpy()] = flat.field("s").to_numpy()
        return pa.ListArray.from_arrays(pa.array(np.arange(len(e) + 1, dtype=np.int32) * width), pa.array(out.ravel()))

    return lists.select("idx", laid_out("e").alias("sums"))


def complement_weights(sums: DataFrame, blocks: list[list[list[int]]], alpha: float = 0.5,
                       column: str = "w") -> DataFrame:
    """(idx, w): per term and class -ln of the share that the term has outside the class.

    ``blocks`` lists independent models; a model lists its classes, a class the
    positions of ``sums`` that it adds up.  One pass serves the coarse model and
    every bucket, with the classes of all blocks side by side.  ``sums`` is read twice; the driver sees one number per
    class.
    """
    mass = sums.select(F.posexplode("sums").alias("k", "s")).groupBy("k").agg(F.sum("s").alias("s"), F.count(F.lit(1)).alias("n")).collect()
    n = mass[0].n if mass else 0
    total = np.zeros(max((r.k for r in mass), default=-1) + 1)
    for r in mass:
        total[r.k] = r.s
    columns = []
    for classes in blocks:
        everything = {i for ids in classes for i in ids}
        columns += [[i in everything and i not in ids for i in range(len(total))] for ids in classes]
    outside = np.array(columns, float).reshape(-1, len(total)).T
    log_total, width = np.log(total @ outside + alpha * n), outside.shape[1]

    @F.arrow_udf("array<double>")
    def weights(s: pa.Array) -> pa.Array:
        out = log_total - np.log(s.flatten().to_numpy().reshape(len(s), -1) @ outside + alpha)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(s) + 1, dtype=np.int32) * width), pa.array(out.ravel()))

    return sums.select("idx", weights("sums").alias(column))
