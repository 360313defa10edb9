"""Fit and apply the two-level categoriser."""

from __future__ import annotations

import json
from dataclasses import asdict
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerleaf import fixed_values as fv
from ledgerleaf.config import CategorizerConfig
from ledgerleaf.functions import text as tx
from ledgerleaf.operators import features as ft
from ledgerleaf.operators import gradients as gr
from ledgerleaf.operators import labels as lb
from ledgerleaf.operators import linear as ln
from ledgerleaf.operators import naive_bayes as nb
from ledgerleaf.operators import sampling as sp
from ledgerleaf.operators import scoring as sc
from ledgerleaf.operators import thresholds as th
from ledgerleaf.plans.storage import materialise, new_path

OUTPUT_COLUMNS = ("label", "confidence", "coarse_label", "coarse_confidence", "needs_review")


class CategorizerModel:
    """A term table with weights plus small per-class facts."""

    #: The training rows' vectors, stored where a logistic head reads them; only a model fitted in this session has them.
    trained_on: ln.Vectors | DataFrame | None = None

    def __init__(self, cfg: CategorizerConfig, terms: DataFrame, heads: list[sc.Head],
                 buckets: dict[str, sc.Bucket], coarse_thresholds: dict[str, float]):
        self.cfg, self.terms, self.heads = cfg, terms, heads
        self.buckets, self.coarse_thresholds = buckets, coarse_thresholds

    @property
    def width(self) -> int:
        return sum(len(h.classes) for h in self.heads)

    def _heads_of(self, bucket: str) -> list[sc.Head]:
        return [h for h in self.heads if h.bucket == bucket]

    @property
    def coarse_classes(self) -> tuple[str, ...]:
        return self._heads_of("")[0].classes

    @property
    def fitted_buckets(self) -> list[str]:
        return [b for b, spec in self.buckets.items() if spec.kind == "fitted"]

    @cached_property
    def ranges(self) -> list[tuple[int, int]]:
        """The blocks of the term table that a task can hold; one for nearly every model."""
        return sc.blocks(self.terms.count(), self.width, sc.MODEL_LIMIT_BYTES)

    @cached_property
    def table(self) -> Broadcast | None:
        """The terms as arrays for every task; None if they are more than one block."""
        if len(self.ranges) > 1:
            return None
        return self.terms.sparkSession.sparkContext.broadcast(sc.TermTable.collect(self.terms, self.width))

    def _vectors(self, df: DataFrame, text: str) -> DataFrame:
        own = materialise(df.withColumn("__row", F.monotonically_increasing_id()))
        return ft.vectorize(own, self.terms, self.cfg, text=text, row_id="__row").drop("__row")

    def probabilities(self, df: DataFrame, *, text: str = "text") -> DataFrame:
        """Add ``coarse_p`` and one ``fine_p_<bucket>`` array per fitted bucket.

        Rows are scored one by one, without a shuffle; a model of several blocks takes one pass for each of them.
        """
        if self.table is not None:
            scored = sc.linear_scores(df, self.table, self.width, self.cfg, text=text)
        else:
            scored = sc.blocked_scores(self._vectors(df, text), self.terms, self.ranges, self.width).drop("features")
        return sc.with_probabilities(scored, self.heads, self.cfg.decision_digits).drop("scores")

    def decide(self, df: DataFrame, *, text: str = "text", low_conf: float | None = None) -> DataFrame:
        """Route and label rows that carry the probability columns."""
        routed = sc.route(df, self.cfg, self.coarse_classes, self.coarse_thresholds, text=text)
        return sc.fine_decide(routed, self.cfg, self.buckets, text=text, low_conf=low_conf)

    def transform(self, df: DataFrame, *, text: str = "text", low_conf: float | None = None,
                  explain: bool = False, details: bool = False) -> DataFrame:
        """Input columns plus label, confidence, coarse label and confidence, review flag.

        Null text scores like empty text.
        """
        if text not in df.columns:
            raise ValueError(f"text column {text!r} not found; available: {df.columns}")
        if low_conf is not None and not 0.0 <= low_conf <= 1.0:
            raise ValueError(f"low_conf must lie in [0, 1], got {low_conf}")
        out = self.decide(self.probabilities(df, text=text), text=text, low_conf=low_conf)
        extra = ("label_raw", "rule", "fine_class", "fitted") if details else ()
        if explain:
            out = self.explain(out, text=text)
            extra = (*extra, "explanation")
        return out.select(*df.columns, *OUTPUT_COLUMNS, *extra)

    def explain(self, decided: DataFrame, *, text: str = "text") -> DataFrame:
        """Add ``explanation`` and ``contributions`` of rows under review, for the class the model put first; null elsewhere."""
        slots = [F.lit(x) for h in self.heads if h.bucket and h.explains
                 for i, c in enumerate(h.classes) for x in (f"{h.bucket}/{c}", h.offset + i)]
        if not slots:
            raise ValueError("the model has no head that explains fine classes")
        key = F.concat_ws("/", "coarse_label", "fine_class")
        slot = F.when(F.col("needs_review") & F.col("fitted"), F.try_element_at(F.create_map(*slots), key))
        rows = sc.fence(decided.withColumn("__slot", slot), "__slot")
        if self.table is not None:
            rows = rows.withColumn("contributions", sc.top_contributions(
                self.table, self.cfg, sc.row_terms(text, self.cfg), F.col("__slot")))
        else:
            due = rows.withColumn("__text", F.when(F.col("__slot").isNotNull(), F.col(text)))
            rows = sc.blocked_contributions(self._vectors(due, "__text"), self.terms, self.ranges, self.width, "__slot",
                                            self.cfg.top_features).drop("features", "__text")
        return rows.withColumn("explanation", sc.explanation(F.col("contributions"))).drop("__slot")

    def certificate(self) -> DataFrame:
        """Per class of the logistic heads: (bucket, cls, n_rows, mass, gradient, start).

        ``gradient`` is the norm of the penalised loss's gradient over all training rows, ``start`` what it is with zero
        coefficients, ``mass`` the class's share of the weighted probabilities.
        """
        if self.trained_on is None:
            raise ValueError("only a model fitted in this session has its training rows")
        vectors, rows = self.trained_on, []
        fitted = [h for h in self.heads if h.intercepts]
        weights = self.terms.select("w").orderBy("idx").toArrow().column("w").combine_chunks().flatten().to_numpy().reshape(-1, self.width)
        for h in fitted:
            coef = weights[:, h.offset: h.offset + len(h.classes)]
            facts = gr.certificate(vectors, h.bucket or None, "label" if h.bucket else "coarse", list(h.classes), coef,
                                   np.array(h.intercepts), h.link, self.cfg)
            rows += [(h.bucket, *x) for x in facts]
        return self.terms.sparkSession.createDataFrame(rows, "bucket string, cls string, n_rows long, mass double, gradient double, start double")

    # ---- persistence ------------------------------------------------------------

    def save(self, path: str) -> None:
        """Term table and facts as two parquet folders."""
        spark = self.terms.sparkSession
        self.terms.write.mode("overwrite").parquet(f"{path}/terms")
        facts = {
            "config": asdict(self.cfg), "heads": [h.as_dict() for h in self.heads],
            "buckets": {b: asdict(s) for b, s in self.buckets.items()},
            "coarse_thresholds": self.coarse_thresholds,
        }
        spark.createDataFrame([(json.dumps(facts),)], "facts string").coalesce(1).write.mode("overwrite").parquet(
            f"{path}/facts")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "CategorizerModel":
        facts = json.loads(spark.read.parquet(f"{path}/facts").first()["facts"])
        required = {"config", "heads", "buckets", "coarse_thresholds"}
        if not required <= set(facts):
            raise TypeError(f"not a categoriser model: missing {sorted(required - set(facts))}")
        raw = {k: tuple(tuple(x) if isinstance(x, list) and k == "override_rules" else x for x in v)
               if isinstance(v, list) else v for k, v in facts["config"].items()}
        buckets = {b: sc.Bucket(s["kind"], tuple(s["classes"]), s["thresholds"]) for b, s in facts["buckets"].items()}
        return cls(CategorizerConfig(**raw), spark.read.parquet(f"{path}/terms"),
                   [sc.Head.from_dict(h) for h in facts["heads"]], buckets, facts["coarse_thresholds"])


class Categorizer:
    """Fits a ``CategorizerModel`` on labelled rows."""

    def __init__(self, cfg: CategorizerConfig | None = None):
        self.cfg = cfg or CategorizerConfig()

    def fit(self, df: DataFrame, *, text: str = "text", label: str = "label",
            row_id: str = "row_id") -> CategorizerModel:
        cfg = self.cfg
        rows = df.select(F.col(row_id).alias("row_id"), F.col(text).alias("text"), F.col(label).alias("label")) \
            .where(F.col("label").isNotNull()).withColumn("coarse", lb.coarse_of(F.col("label"), cfg.hierarchy))
        # the narrow table is read by every pass below; the source may be wide or costly to derive
        path = new_path(df.sparkSession, "training")
        rows.write.parquet(path)
        rows = df.sparkSession.read.parquet(path)
        if cfg.calibrate_on == "holdout":
            held = tx.draw(F.col("row_id"), f"holdout-{cfg.coarse_seed}") < cfg.holdout_fraction
            train, calibration = rows.where(~held), rows.where(held)
        else:
            train = calibration = rows
        layout = self._layout(train)
        vocab = materialise(ft.fit_vocabulary(train, cfg))
        # logistic fits read the vectors many times, so they are stored; the sums of naive Bayes take one pass
        featured, vectors = ft.vectorize(train, vocab, cfg), None
        if cfg.coarse_trainer != "nb" or (cfg.fine_trainer == "ensemble" and any(len(kids) > 1 for kids in layout.values())):
            vectors = ln.Vectors(featured, sorted(layout), vocab.count())
            featured = vectors.arrays()
        terms, heads = self._fit_heads(vectors, featured, vocab, layout)
        buckets = {
            b: sc.Bucket("missing") if not kids else
            sc.Bucket("solo", tuple(kids), {kids[0]: cfg.effective_fine_floors.get(kids[0], fv.DEFAULT_THRESHOLD)})
            if len(kids) == 1 else sc.Bucket("fitted", tuple(kids))
            for b, kids in layout.items()
        }
        model = self._calibrate(CategorizerModel(cfg, terms, heads, buckets, {}), calibration)
        model.trained_on = featured if vectors is None else vectors
        return model

    def _layout(self, train: DataFrame) -> dict[str, list[str]]:
        """Labels present per coarse bucket; as small as the taxonomy."""
        found = train.select("coarse", "label").distinct().limit(self.cfg.max_labels + 1).collect()
        if len(found) > self.cfg.max_labels:
            raise ValueError(f"more than {self.cfg.max_labels} distinct labels; is the label column right?")
        layout = {k: [] for k in fv.COARSE_KEYS}
        for r in found:
            layout.setdefault(r["coarse"], []).append(r["label"])
        return {k: sorted(v) for k, v in layout.items()}

    def _fit_heads(self, vectors, featured, vocab, layout):
        """Term table and heads: the linear blocks come first in the weight array, then the Bayes blocks.

        ``vectors`` are the stored rows, None where no logistic head is fitted; ``featured`` are the same rows with arrays.
        """
        cfg = self.cfg
        coarse = sorted(b for b, kids in layout.items() if kids)
        fine = {b: kids for b, kids in layout.items() if len(kids) > 1}
        all_labels = sorted(x for kids in layout.values() for x in kids)
        position = {lab: i for i, lab in enumerate(all_labels)}
        ensemble = cfg.fine_trainer == "ensemble" and bool(fine)
        linear_vote, bayes_vote = cfg.ensemble_weights if ensemble else (0.0, 1.0)

        heads, matrices, blocks, offset = [], [], [], 0
        if cfg.coarse_trainer != "nb" or ensemble:
            jobs = []
            if cfg.coarse_trainer != "nb":
                if cfg.coarse_trainer == "lr":
                    jobs.append(("", coarse, "softmax", 1.0, lambda: ln.fit_softmax(
                        vectors.vectors(), "coarse", coarse, cfg, cfg.coarse_tol)))
                elif cfg.coarse_trainer == "sgd":
                    jobs.append(("", coarse, "ovr", 1.0, lambda: gr.fit_sgd(vectors, "coarse", coarse, cfg)))
                else:
                    jobs.append(("", coarse, "ovr", 1.0, lambda: ln.fit_one_vs_rest(vectors.vectors(), "coarse", coarse, cfg)))
            if ensemble:
                jobs += [(b, kids, "softmax", linear_vote, lambda b=b, kids=kids: ln.fit_softmax(
                    vectors.vectors(b), "label", kids, cfg)) for b, kids in fine.items()]
            fits = ln.fit_many([job for *_, job in jobs], [vectors.n_features * len(classes) for _, classes, *_ in jobs])
            for (bucket, classes, how, vote, _), (coef, intercepts) in zip(jobs, fits):
                heads.append(sc.Head(bucket, tuple(classes), offset, how, vote, tuple(intercepts), bool(bucket)))
                matrices.append(np.asarray(coef).T)
                offset += len(classes)
        if cfg.coarse_trainer == "nb":
            heads.append(sc.Head("", tuple(coarse), offset))
            blocks.append([[position[x] for x in layout[b]] for b in coarse])
            offset += len(coarse)
        for b, kids in fine.items():
            heads.append(sc.Head(b, tuple(kids), offset, vote=bayes_vote, explains=not ensemble))
            blocks.append([[position[x]] for x in kids])
            offset += len(kids)

        table, parts = vocab.select("term", "idx", "idf"), []
        if matrices:
            table = table.join(_weight_table(vocab.sparkSession, np.hstack(matrices)), "idx")
            parts.append(F.col("w"))
        if blocks:
            sums = materialise(nb.class_sums(featured, "label", all_labels))
            table = table.join(nb.complement_weights(sums, blocks, cfg.nb_alpha, "nb_w"), "idx")
            parts.append(F.col("nb_w"))
        return materialise(table.select("term", "idx", "idf", F.concat(*parts).alias("w"))), heads

    def _calibrate(self, model: CategorizerModel, rows: DataFrame) -> CategorizerModel:
        cfg = self.cfg
        coarse = sp.coarse_calibration_sample(rows, "row_id", cfg.coarse_cal_size, cfg.coarse_cal_divisor,
                                              cfg.coarse_seed).withColumn("level", F.lit("coarse"))
        fitted = model.fitted_buckets
        fine = sp.fine_calibration_sample(rows.where(F.col("coarse").isin(*fitted)), "row_id", "coarse",
                                          cfg.fine_cal_size, cfg.fine_cal_min, cfg.fine_cal_frac, cfg.fine_seed
                                          ).withColumn("level", F.lit("fine"))
        sample = coarse.unionByName(fine) if fitted else coarse
        scored = model.probabilities(sample)
        found = th.threshold_search(calibration_pairs(scored, model), ["level", "bucket", "cls"],
                                    rule=cfg.threshold_rule)
        coarse_thr, fine_thr = {}, {}
        for r in found.collect():               # one row per class
            floors = cfg.coarse_floors if r["level"] == "coarse" else cfg.effective_fine_floors
            value = max(r["threshold"], floors.get(r["cls"], r["threshold"]))
            if r["level"] == "coarse":
                coarse_thr[r["cls"]] = value
            else:
                fine_thr.setdefault(r["bucket"], {})[r["cls"]] = value
        buckets = {b: sc.Bucket(s.kind, s.classes, fine_thr.get(b, s.thresholds)) for b, s in model.buckets.items()}
        return CategorizerModel(cfg, model.terms, model.heads, buckets, coarse_thr)


def calibration_pairs(scored: DataFrame, model: CategorizerModel) -> DataFrame:
    """(level, bucket, cls, y, p): one row per sampled row and class of its level."""
    def pairs(classes, p, truth):
        quoted = [c.replace("\\", "\\\\").replace("'", "\\'") for c in classes]
        names = "array(" + ", ".join(f"'{c}'" for c in quoted) + ")"
        return F.expr(f"transform({p}, (x, i) -> named_struct('cls', {names}[i], "
                      f"'y', cast({names}[i] = {truth} AS int), 'p', x))")

    per_row = F.when(F.col("level") == "coarse", pairs(model.coarse_classes, "coarse_p", "coarse"))
    for b in model.fitted_buckets:
        per_row = per_row.when(F.col("coarse") == b, pairs(model.buckets[b].classes, f"fine_p_{b}", "label"))
    bucket = F.when(F.col("level") == "coarse", "").otherwise(F.col("coarse"))
    return scored.select("level", bucket.alias("bucket"), F.inline(per_row))


def _weight_table(spark: SparkSession, matrix: np.ndarray) -> DataFrame:
    """(idx, w) from a feature x class matrix that training left on the driver."""
    path = new_path(spark, "coef")
    rows, width = matrix.shape
    offsets = pa.array(np.arange(rows + 1, dtype=np.int32) * width)
    weights = pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(matrix).ravel()))
    table = pa.table({"idx": pa.array(np.arange(rows, dtype=np.int32)), "w": weights})
    spark.createDataFrame(table).write.parquet(path)
    return spark.read.parquet(path)
