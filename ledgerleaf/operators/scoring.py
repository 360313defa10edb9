"""Linear scores of text rows and the decisions made from them."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerleaf import fixed_values as fv
from ledgerleaf.config import CategorizerConfig
from ledgerleaf.functions import lexicon as lx
from ledgerleaf.functions import text as tx
from ledgerleaf.operators import features as ft
from ledgerleaf.plans.storage import materialise

MODEL_LIMIT_BYTES = 256 * 1024 * 1024      # of a model that each task holds
SCORE_ROWS = 64                            # rows whose weights are laid out at a time


@dataclass(frozen=True)
class Head:
    """One linear model: a block of positions in the weight array of each term."""

    bucket: str                       # '' for the coarse router
    classes: tuple[str, ...]
    offset: int
    link: str = "softmax"             # 'softmax' | 'ovr'
    vote: float = 1.0
    intercepts: tuple[float, ...] = ()
    explains: bool = False

    def as_dict(self) -> dict:
        return asdict(self)

    @classmethod
    def from_dict(cls, d: dict) -> "Head":
        return cls(**{**d, "classes": tuple(d["classes"]), "intercepts": tuple(d["intercepts"])})


@dataclass
class TermTable(ft.Terms):
    """A model's terms as arrays that a task holds, with one weight per class."""

    weights: np.ndarray

    @classmethod
    def collect(cls, terms: DataFrame, width: int) -> "TermTable":
        """``terms`` (term, idx, idf, w), whose size ``fits`` has to allow."""
        rows = terms.select("term", "idf", "w").orderBy("idx").toArrow()
        names = rows.column("term").combine_chunks()
        words = pc.starts_with(names, tx.WORD_PREFIX).to_numpy(zero_copy_only=False)
        flat = rows.column("w").combine_chunks().flatten()
        return cls(names, rows.column("idf").to_numpy(), words, flat.to_numpy().reshape(-1, width))


def fits(terms: DataFrame, width: int) -> bool:
    """Whether a task can hold the model."""
    return ft.fits(terms, width, MODEL_LIMIT_BYTES)


row_terms = ft.row_terms


def linear_scores(df: DataFrame, table: Broadcast, width: int, cfg: CategorizerConfig, *, text: str = "text") -> DataFrame:
    """Add ``scores``: the dot products of each row's TF-IDF vector with the weight columns.

    A row is scored by itself: no shuffle, no id; equal or null ids do not matter.  Rows without a known term have
    zeros.  ``table`` is a broadcast ``TermTable``.
    """

    @F.arrow_udf("array<double>")
    def dot(lists: pa.Array) -> pa.Array:
        model = table.value
        row, at, value = model.vectors(lists, cfg)
        out = np.zeros((len(lists), width))
        for a in range(0, len(lists), SCORE_ROWS):
            lo, hi = np.searchsorted(row, [a, a + SCORE_ROWS])
            if lo < hi:
                first = np.flatnonzero(np.diff(row[lo:hi], prepend=-1))
                out[row[lo:hi][first]] = np.add.reduceat(model.weights[at[lo:hi]] * value[lo:hi, None], first, axis=0)
        ends = np.arange(len(lists) + 1, dtype=np.int32) * width
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(out.ravel()))

    return df.withColumn("scores", dot(row_terms(text, cfg)))


def blocks(n_terms: int, width: int, limit: int = MODEL_LIMIT_BYTES) -> list[tuple[int, int]]:
    """Ranges of term positions whose weights a task can hold; together all terms."""
    per = max(1, limit // (ft.TERM_BYTES + 8 * max(width, 1)))
    return [(lo, min(lo + per, n_terms)) for lo in range(0, n_terms, per)]


@dataclass
class Block:
    """The weights of the terms from position ``start`` on."""

    start: int
    terms: pa.Array
    weights: np.ndarray

    @classmethod
    def collect(cls, terms: DataFrame, width: int, lo: int, hi: int) -> "Block":
        rows = terms.where(F.col("idx").between(lo, hi - 1)).select("term", "w").orderBy("idx").toArrow()
        flat = rows.column("w").combine_chunks().flatten()
        return cls(lo, rows.column("term").combine_chunks(), flat.to_numpy().reshape(-1, width))

    def entries(self, features: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, position in the block, value) of the entries of ``features`` that lie in the block."""
        indices, values = features.field("indices"), features.field("values")
        row, at = indices.value_parent_indices().to_numpy(), indices.flatten().to_numpy() - self.start
        inside = (at >= 0) & (at < len(self.weights))
        return row[inside], at[inside], values.flatten().to_numpy()[inside]


def _adds(held: Broadcast, width: int):
    @F.arrow_udf("array<double>")
    def add(scores: pa.Array, features: pa.Array) -> pa.Array:
        out = scores.flatten().to_numpy().reshape(len(scores), width).copy()
        row, at, value = held.value.entries(features)
        for a in range(0, len(out), SCORE_ROWS):
            i, j = np.searchsorted(row, [a, a + SCORE_ROWS])
            if i < j:
                first = np.flatnonzero(np.diff(row[i:j], prepend=-1))
                out[row[i:j][first]] += np.add.reduceat(held.value.weights[at[i:j]] * value[i:j, None], first, axis=0)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * width), pa.array(out.ravel()))

    return add


def _block_by_block(rows: DataFrame, terms: DataFrame, ranges: list[tuple[int, int]], width: int, column: str, step) -> DataFrame:
    """``column`` after ``step(rows, broadcast block)`` for each block of the term table.

    A block is broadcast alone; the rows are stored in between, so that a task holds one block.  Rows never shuffle.
    """
    for n, (lo, hi) in enumerate(ranges):
        held = rows.sparkSession.sparkContext.broadcast(Block.collect(terms, width, lo, hi))
        rows = rows.withColumn(column, step(held))
        if n + 1 < len(ranges):
            rows = materialise(rows)
    return rows


def blocked_scores(vectors: DataFrame, terms: DataFrame, ranges: list[tuple[int, int]], width: int) -> DataFrame:
    """Add ``scores`` to rows with ``features``, for a model that no task can hold: every block adds its part."""
    rows = vectors.withColumn("scores", F.array_repeat(F.lit(0.0), width))
    return _block_by_block(rows, terms, ranges, width, "scores", lambda held: _adds(held, width)("scores", "features"))


def with_probabilities(df: DataFrame, heads: list[Head], digits: int, *, scores: str = "scores",
                       prefix: str = "fine_p_") -> DataFrame:
    """Add ``coarse_p`` and one ``fine_p_<bucket>`` array per bucket with heads.

    Links, votes and rounding of all heads are one Arrow function, next to the one that makes the scores, whatever the
    number of classes.  Heads of one bucket vote by weight.  Null scores count as zeros.
    """
    buckets = {bucket: [h for h in heads if h.bucket == bucket] for bucket in dict.fromkeys(h.bucket for h in heads)}
    names = [f"{prefix}{bucket}" if bucket else "coarse_p" for bucket in buckets]
    width, scale = max(h.offset + len(h.classes) for h in heads), 10.0 ** digits

    @F.arrow_udf("struct<" + ",".join(f"p{i}:array<double>" for i in range(len(names))) + ">")
    def linked(lists: pa.Array) -> pa.Array:
        z = np.zeros((len(lists), width))
        given = np.flatnonzero(lists.is_valid().to_numpy(zero_copy_only=False))
        if len(given):
            z[given] = lists.flatten().to_numpy().reshape(len(given), -1)[:, :width]
        out = []
        for mine in buckets.values():
            p = sum(h.vote * probabilities(z, h) for h in mine) / sum(h.vote for h in mine)
            p = np.floor(p * scale + 0.5) / scale
            ends = np.arange(len(z) + 1, dtype=np.int32) * p.shape[1]
            out.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(p.ravel())))
        return pa.StructArray.from_arrays(out, [f"p{i}" for i in range(len(out))])

    linked_ = df.withColumn("__linked", linked(F.col(scores)))
    return linked_.withColumns({name: F.col(f"__linked.p{i}") for i, name in enumerate(names)}).drop("__linked")


def probabilities(scores: np.ndarray, head: Head) -> np.ndarray:
    """Class probabilities of one head for rows of ``scores``."""
    z = scores[:, head.offset: head.offset + len(head.classes)] + np.array(head.intercepts or 0.0)
    e = np.exp(z - z.max(axis=1, keepdims=True)) if head.link == "softmax" else 1 / (1 + np.exp(-z))
    return e / e.sum(axis=1, keepdims=True)


def _sum(columns: list[Column]) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = out + c
    return out


def coarse_boost(df: DataFrame, classes, cfg: CategorizerConfig, *, text: str = "text", p: str = "coarse_p",
                 digits: int | None = None) -> DataFrame:
    """Add ``boosted_p``: each coarse class with a lexicon hit gains ``bump`` once, then all rescale to sum 1.

    With ``boost_alignment='positional'`` the gain goes by position in
    ``COARSE_KEYS`` instead of by name, which shifts it to another class where
    the two orders differ.
    """
    hits = lx.coarse_hits(F.col(text), cfg.lexicon, cfg.lexicon_coarse)
    order = classes if cfg.boost_alignment == "key" else fv.COARSE_KEYS[: len(classes)]
    gain = [F.when(hits[key], F.lit(cfg.bump)).otherwise(F.lit(0.0)) if key in hits else F.lit(0.0) for key in order]
    raised = {f"__r{i}": F.col(p)[i] + g for i, g in enumerate(gain)}
    out = df.withColumns(raised).withColumn("__sum", _sum([F.col(c) for c in raised]))
    scaled = [F.when(F.col("__sum") > 0, F.col(c) / F.col("__sum")).otherwise(F.col(c)) for c in raised]
    return out.withColumn("boosted_p", F.array(*[F.round(s, digits) if digits is not None else s for s in scaled])) \
        .drop(*raised, "__sum")


def fence(df: DataFrame, *columns: str) -> DataFrame:
    """Pass the named columns through a one-row generator.

    A later filter on them stays above the generator.  Without it the optimizer
    would copy the whole probability arithmetic into the filter, step by step,
    until planning no longer ends.
    """
    rest = [c for c in df.columns if c not in columns]
    return df.select(*rest, F.stack(F.lit(1), *[F.col(c) for c in columns]).alias(*columns))


def argmax_class(p: Column, classes) -> Column:
    """Class with the highest probability; the first of equals."""
    return F.element_at(F.array(*[F.lit(c) for c in classes]), F.array_position(p, F.array_max(p)).cast("int"))


def _lookup(values: dict, key: Column, default) -> Column:
    if not values:
        return F.lit(default)
    pairs = [F.lit(x) for kv in values.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(default))


def route(df: DataFrame, cfg: CategorizerConfig, classes, thresholds: dict, *, text: str = "text") -> DataFrame:
    """Boost, take the top class, send rows below its threshold to the default bucket.

    ``coarse_confidence`` stays the boosted top probability also for such rows.
    """
    top = coarse_boost(df, classes, cfg, text=text, digits=cfg.decision_digits) \
        .withColumn("coarse_top", argmax_class(F.col("boosted_p"), classes)) \
        .withColumn("coarse_confidence", F.array_max("boosted_p"))
    reached = F.col("coarse_confidence") >= _lookup(thresholds, F.col("coarse_top"), fv.DEFAULT_THRESHOLD)
    routed = top.withColumn("coarse_label", F.when(reached, F.col("coarse_top")).otherwise(fv.DEFAULT_COARSE))
    return fence(routed, "boosted_p", "coarse_top", "coarse_confidence", "coarse_label")


@dataclass(frozen=True)
class Bucket:
    """How one coarse bucket is decided."""

    kind: str                                   # 'fitted' | 'solo' | 'missing'
    classes: tuple[str, ...] = ()
    thresholds: dict = field(default_factory=dict)


def fine_decide(df: DataFrame, cfg: CategorizerConfig, buckets: dict[str, Bucket], *, text: str = "text",
                low_conf: float | None = None) -> DataFrame:
    """Fine label, confidence and review flag from ``coarse_label`` and ``fine_p_<bucket>``.

    Solo buckets answer with their label, missing ones with the fallback label;
    neither is overridden.  In a fitted bucket a top probability below its
    threshold turns into the fallback label where the bucket knows it; then
    the override rules apply.  Overrides leave the confidence alone.
    """
    low = cfg.low_conf if low_conf is None else low_conf
    is_ = lambda names: F.col("coarse_label").isin(*names) if names else F.lit(False)
    fitted = [b for b, spec in buckets.items() if spec.kind == "fitted"]
    solo = {b: spec.classes[0] for b, spec in buckets.items() if spec.kind == "solo"}

    def per_bucket(make) -> Column:
        out = F.lit(None)
        for b in fitted:
            out = F.when(F.col("coarse_label") == b, make(b)).otherwise(out)
        return out

    chosen = df.withColumn("fine_class", per_bucket(lambda b: argmax_class(F.col(f"fine_p_{b}"), buckets[b].classes))) \
        .withColumn("fine_top", per_bucket(lambda b: F.array_max(f"fine_p_{b}")))

    def fallback_p(b):
        names = buckets[b].classes
        return F.col(f"fine_p_{b}")[names.index(fv.FALLBACK_LABEL)] if fv.FALLBACK_LABEL in names else F.lit(None)

    def threshold(b):
        return _lookup({**cfg.effective_fine_floors, **buckets[b].thresholds}, F.col("fine_class"), fv.DEFAULT_THRESHOLD)

    chosen = chosen.withColumn("fine_threshold", per_bucket(threshold)) \
        .withColumn("fallback_p", per_bucket(fallback_p).cast("double"))
    weak = (F.col("fine_top") < F.col("fine_threshold")) & F.col("fallback_p").isNotNull()
    is_solo, is_fitted = is_(list(solo)), is_(fitted)
    label_raw = F.when(is_solo, _lookup(solo, F.col("coarse_label"), "")) \
        .when(is_fitted, F.when(weak, fv.FALLBACK_LABEL).otherwise(F.col("fine_class"))).otherwise(fv.FALLBACK_LABEL)
    confidence = F.when(is_solo, F.lit(fv.SOLO_CONFIDENCE)) \
        .when(is_fitted, F.when(weak, F.col("fallback_p")).otherwise(F.col("fine_top"))) \
        .otherwise(F.lit(fv.MISSING_CONFIDENCE))
    rule = F.when(is_fitted, lx.override_rule(F.col(text), cfg.override_rules))
    out = chosen.withColumns({"label_raw": label_raw, "confidence": confidence, "rule": rule, "fitted": is_fitted})
    out = out.withColumn("label", lx.apply_override(F.col("label_raw"), F.col("rule"), cfg.override_rules)) \
        .withColumn("needs_review", F.when(F.col("fitted"), F.col("confidence")).otherwise(
            F.col("coarse_confidence")) < low)
    return fence(out, "fine_class", "label_raw", "label", "rule", "fitted", "confidence", "needs_review")


def top_contributions(table: Broadcast, cfg: CategorizerConfig, terms: Column, slot: Column) -> Column:
    """Array of (term, contribution): the terms of a row that add most to the class at weight position ``slot``.

    Equal contributions (to nine digits) keep the order of the vocabulary.  Null where ``slot`` is null; such
    rows are not expanded into terms.
    """
    k = cfg.top_features

    @F.arrow_udf("array<struct<term:string,contribution:double>>")
    def top(lists: pa.Array, slots: pa.Array) -> pa.Array:
        model = table.value
        row, at, value = model.vectors(lists, cfg)
        want = pc.fill_null(slots, 0).to_numpy()
        amount = np.round(value * model.weights[at, want[row]], 9) if len(row) else value
        order = np.lexsort((at, -amount, row))
        row, at, amount = row[order], at[order], amount[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        keep = place < k
        ends = np.concatenate([[0], np.cumsum(np.bincount(row[keep], minlength=len(lists)))]).astype(np.int32)
        rows = pa.StructArray.from_arrays([model.terms.take(pa.array(at[keep])), pa.array(amount[keep])], ["term", "contribution"])
        return pa.ListArray.from_arrays(pa.array(ends), rows)

    found = top(F.when(slot.isNotNull(), terms), slot.cast("int"))
    return F.when(slot.isNotNull(), found)


TOP = "array<struct<at:int,term:string,contribution:double>>"


def _merges(held: Broadcast, k: int):
    @F.arrow_udf(TOP)
    def merged(so_far: pa.Array, features: pa.Array, slots: pa.Array) -> pa.Array:
        block, best = held.value, so_far.flatten()
        row, at, value = block.entries(features)
        amount = np.round(value * block.weights[at, pc.fill_null(slots, 0).to_numpy()[row]], 9) if len(row) else value
        names = pa.concat_arrays([best.field("term"), block.terms.take(pa.array(at))])
        row = np.concatenate([so_far.value_parent_indices().to_numpy(), row])
        at = np.concatenate([best.field("at").to_numpy(), at + block.start])
        amount = np.concatenate([best.field("contribution").to_numpy(), amount])
        order = np.lexsort((at, -amount, row))
        place = np.arange(len(order)) - np.searchsorted(row[order], row[order])
        keep = order[place < k]
        ends = np.searchsorted(row[keep], np.arange(len(so_far) + 1)).astype(np.int32)
        parts = [pa.array(at[keep].astype(np.int32)), names.take(pa.array(keep)), pa.array(amount[keep])]
        return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(parts, ["at", "term", "contribution"]))

    return merged


def blocked_contributions(vectors: DataFrame, terms: DataFrame, ranges: list[tuple[int, int]], width: int, slot: str, k: int) -> DataFrame:
    """Add ``contributions`` to rows with ``features``: as ``top_contributions``, the best ``k`` so far merged with each block's."""
    rows = _block_by_block(vectors.withColumn("__top", F.array().cast(TOP)), terms, ranges, width, "__top",
                           lambda held: _merges(held, k)("__top", "features", F.col(slot).cast("int")))
    found = F.transform("__top", lambda x: F.struct(x["term"].alias("term"), x["contribution"].alias("contribution")))
    return rows.withColumn("contributions", F.when(F.col(slot).isNotNull(), found)).drop("__top")


def explanation(contributions: Column) -> Column:
    """``term:amount`` parts joined by "; "; null where nothing contributes."""
    parts = F.transform(contributions, lambda c: F.concat(c["term"], F.lit(":"), tx.fixed_decimals(c["contribution"], 2, 9)))
    return F.when(F.size(contributions) > 0, F.array_join(parts, "; "))
