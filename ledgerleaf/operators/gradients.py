"""Gradients of linear models over stored vectors, and what they are good for.

One distributed pass sums the gradient of the loss by feature; the driver sees one number per feature and class, which the
configuration bounds, and never a row.  Mini-batch descent takes such a pass over a batch as a step; a pass over all rows
certifies a fit that another optimiser made.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerleaf.config import CategorizerConfig
from ledgerleaf.operators.linear import Vectors

BIAS, MASS, ROWS = -1, -2, -3        # what stands in place of a feature number
STEP_ROWS = 4_096                    # rows whose weights are laid out at a time
SENT_ROWS = 16_384                   # features of a task's gradient that are sent at a time


@dataclass(frozen=True)
class Gradient:
    """Sums over rows: of weight * (p - y) * x by feature and class, without x for the intercept, of weight * p, of weights."""

    features: np.ndarray
    intercepts: np.ndarray
    mass: np.ndarray
    weight: float


def link_of(z: np.ndarray, link: str) -> np.ndarray:
    if link == "softmax":
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)
    return 1 / (1 + np.exp(-z))


def row_gradients(row: np.ndarray, at: np.ndarray, value: np.ndarray, y: np.ndarray, w: np.ndarray, coef: np.ndarray,
                  bias: np.ndarray, link: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature numbers, their gradients, p) of rows given as sorted (row, feature, value) entries, classes and weights."""
    z = np.zeros((len(y), coef.shape[1]))
    if len(row):
        first = np.flatnonzero(np.diff(row, prepend=-1))
        z[row[first]] = np.add.reduceat(coef[at] * value[:, None], first, axis=0)
    p = link_of(z + bias, link)
    off = p.copy()
    off[np.arange(len(y)), y] -= 1
    off *= w[:, None]
    order = np.argsort(at, kind="stable")
    at, parts = at[order], off[row[order]] * value[order, None]
    if not len(at):
        return at, parts, p
    first = np.flatnonzero(np.diff(at, prepend=-1))
    return at[first], np.add.reduceat(parts, first, axis=0), p


def gradient(rows: DataFrame, y: Column, weight: Column, coef: np.ndarray, bias: np.ndarray, link: str) -> Gradient:
    """``rows`` has ``features`` as arrays; ``y`` is the number of a row's class, ``coef`` feature x class."""
    n, width = coef.shape
    held = rows.sparkSession.sparkContext.broadcast((coef, bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coef, bias = held.value
        # a task adds up the gradients of its rows and sends each feature once
        total, seen, extra = np.zeros((max(n, 1), width)), np.zeros(n, bool), np.zeros((3, width))
        for whole in batches:
            for start in range(0, whole.num_rows, STEP_ROWS):
                batch = whole.slice(start, STEP_ROWS)
                lists = batch.column("indices")
                row = lists.value_parent_indices().to_numpy()
                own_y, own_w = batch.column("y").to_numpy(), batch.column("w").to_numpy()
                at, g, p = row_gradients(row, lists.flatten().to_numpy(), batch.column("values").flatten().to_numpy(),
                                         own_y, own_w, coef, bias, link)
                off = p.copy()
                off[np.arange(len(own_y)), own_y] -= 1
                total[at] += g
                seen[at] = True
                extra += np.stack([own_w @ off, own_w @ p, np.full(width, own_w.sum())])
        at = np.flatnonzero(seen)
        idx = np.concatenate([at, [BIAS, MASS, ROWS]]).astype(np.int32)
        for a in range(0, len(idx), SENT_ROWS):
            part = idx[a: a + SENT_ROWS]
            flat = np.where(part[:, None] >= 0, total[np.maximum(part, 0)], extra[np.clip(-1 - part, 0, 2)]).ravel()
            ends = pa.array(np.arange(len(part) + 1, dtype=np.int32) * width)
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.ListArray.from_arrays(ends, pa.array(flat))], ["idx", "g"])

    numbered = rows.select("features.indices", "features.values", y.cast("int").alias("y"), weight.cast("double").alias("w"))
    parts = numbered.mapInArrow(run, "idx int, g array<double>")
    found = parts.groupBy("idx").agg(*[F.sum(F.col("g")[k]).alias(f"g{k}") for k in range(width)]).toArrow()
    held.destroy()
    idx = found.column("idx").to_numpy()
    sums = np.stack([found.column(f"g{k}").to_numpy() for k in range(width)], axis=1)
    features = np.zeros((n, width))
    features[idx[idx >= 0]] = sums[idx >= 0]
    extra = {i: sums[idx == i][0] if (idx == i).any() else np.zeros(width) for i in (BIAS, MASS, ROWS)}
    return Gradient(features, extra[BIAS], extra[MASS], float(extra[ROWS][0]))


def class_number(label: str, classes: list[str]) -> Column:
    return F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label)).cast("int") - 1


# ---- mini-batch descent ------------------------------------------------------------------


def step_size(step: int, cfg: CategorizerConfig) -> float:
    """Falls with the root of the steps taken."""
    return cfg.sgd_step / (1 + step / cfg.sgd_batches) ** 0.5


def batch_order(epoch: int, cfg: CategorizerConfig) -> np.ndarray:
    """The pieces of each batch of an epoch, drawn by the epoch's seed: (batches, pieces a batch)."""
    pieces = np.random.default_rng(cfg.coarse_seed + epoch).permutation(cfg.sgd_batches * cfg.sgd_pieces)
    return pieces.reshape(cfg.sgd_batches, cfg.sgd_pieces)


def descend(coef: np.ndarray, bias: np.ndarray, g: Gradient, step: int, cfg: CategorizerConfig) -> tuple[np.ndarray, np.ndarray]:
    """One step along the mean gradient of a batch; the penalty shrinks coefficients, not intercepts."""
    if not g.weight:
        return coef, bias
    eta = step_size(step, cfg)
    return coef * (1 - eta * cfg.ovr_reg_param) - eta * g.features / g.weight, bias - eta * g.intercepts / g.weight


def piece_of(row_id: Column, cfg: CategorizerConfig) -> Column:
    """The hash of its id puts a row into one of the pieces of which batches are made."""
    return F.pmod(F.xxhash64(row_id, F.lit(cfg.coarse_seed)), F.lit(cfg.sgd_batches * cfg.sgd_pieces)).cast("int")


def fit_sgd(vectors: Vectors, label: str, classes: list[str], cfg: CategorizerConfig, *, row_id: str = "row_id"):
    """Mini-batch descent on the log loss of one model per class; (class x feature coefficients, intercepts).

    An epoch has ``sgd_batches`` batches whatever the size of the table, so the number of Spark jobs does not grow with
    it.  Rows are written once into one folder per piece; a batch reads the folders of its pieces alone, and every epoch
    deals the pieces to batches anew.
    """
    pieces = vectors.in_pieces(piece_of(F.col(row_id), cfg), cfg.sgd_batches * cfg.sgd_pieces)
    coef, bias = np.zeros((vectors.n_features, len(classes))), np.zeros(len(classes))
    step, y = 0, class_number(label, classes)
    for epoch in range(cfg.sgd_epochs):
        for batch in batch_order(epoch, cfg):
            rows = pieces.where(F.col("__piece").isin(*batch.tolist()))
            coef, bias = descend(coef, bias, gradient(rows, y, F.lit(1.0), coef, bias, "ovr"), step, cfg)
            step += 1
    return list(coef.T), [float(x) for x in bias]


# ---- certificate -------------------------------------------------------------------------


def certificate(vectors: Vectors, bucket: str | None, label: str, classes: list[str], coef: np.ndarray, bias: np.ndarray,
                link: str, cfg: CategorizerConfig) -> list[tuple[str, int, float, float, float]]:
    """Per class (name, rows, share of the weighted probability mass, gradient norm, norm at zero coefficients).

    At the optimum the gradient of the penalised loss is zero; the second norm is what it is before any fit, and tells how
    small the first one is.  Intercepts carry no penalty, so there the mass of a class equals the weight of its rows.
    """
    rows = vectors.arrays(bucket)
    counts = {r["label"]: r["n"] for r in rows.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n")).collect()}
    n = sum(counts.values())
    weight, penalty = F.lit(1.0), cfg.ovr_reg_param
    if link == "softmax":
        pairs = [F.lit(x) for c in classes for x in (c, n / (len(classes) * counts[c]))]
        weight = F.element_at(F.create_map(*pairs), F.col(label))
        penalty = (2.0 if len(classes) == 2 else 1.0) / (cfg.inverse_regularisation * n)
    y = class_number(label, classes)

    def norms(coef: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, Gradient]:
        g = gradient(rows, y, weight, coef, bias, link)
        whole = np.vstack([g.features / g.weight + penalty * coef, g.intercepts / g.weight])
        return np.sqrt((whole ** 2).sum(axis=0)), g

    reached, g = norms(coef, bias)
    start, _ = norms(np.zeros_like(coef), np.zeros_like(bias))
    return [(c, counts[c], float(g.mass[k] / g.weight), float(reached[k]), float(start[k])) for k, c in enumerate(classes)]
