"""Distributed gradients against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerleaf.config import CategorizerConfig
from ledgerleaf.operators import features as ft
from ledgerleaf.operators import gradients as gr
from ledgerleaf.operators import labels as lb
from ledgerleaf.operators import linear as ln
from ledgerleaf.plans import queries as q
from ledgerleaf.plans.categorizer import Categorizer

CFG = CategorizerConfig(sgd_epochs=2, sgd_batches=3)


@pytest.fixture(scope="module")
def vectors(spark, sf_dir):
    rows = q.lines(spark, sf_dir).where("row_id < 300").select("row_id", "text", F.col("true_label").alias("label")).withColumn(
        "coarse", lb.coarse_of(F.col("label"), CFG.hierarchy))
    vocab = ft.fit_vocabulary(rows, CFG)
    return ln.Vectors(ft.vectorize(rows, vocab, CFG), sorted(CFG.hierarchy), vocab.count())


@pytest.fixture(scope="module")
def dense(vectors):
    """(row ids, matrix, coarse labels) on the driver, for the plain versions."""
    rows = vectors.arrays().collect()
    x = np.zeros((len(rows), vectors.n_features))
    for i, r in enumerate(rows):
        x[i, r["features"]["indices"]] = r["features"]["values"]
    return [r["row_id"] for r in rows], x, [r["coarse"] for r in rows]


def plain_gradient(x, y, w, coef, bias, link):
    z = x @ coef + bias
    p = 1 / (1 + np.exp(-z))
    if link == "softmax":
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
    off = (p - np.eye(coef.shape[1])[y]) * w[:, None]
    return x.T @ off, off.sum(axis=0), (p * w[:, None]).sum(axis=0)


@pytest.mark.parametrize("link", ["softmax", "ovr"])
def test_gradient(vectors, dense, link):
    ids, x, labels = dense
    classes = sorted(set(labels))
    rng = np.random.default_rng(1)
    coef, bias = rng.normal(size=(x.shape[1], len(classes))), rng.normal(size=len(classes))
    weight = F.when(F.col("row_id") % 2 == 0, 2.0).otherwise(0.5)
    g = gr.gradient(vectors.arrays(), gr.class_number("coarse", classes), weight, coef, bias, link)
    w = np.array([2.0 if i % 2 == 0 else 0.5 for i in ids])
    want = plain_gradient(x, [classes.index(c) for c in labels], w, coef, bias, link)
    for a, b in zip((g.features, g.intercepts, g.mass), want, strict=True):
        np.testing.assert_allclose(a, b, rtol=1e-9, atol=1e-9)
    assert g.weight == w.sum()


def test_descent_equals_a_plain_loop(spark, vectors, dense):
    ids, x, labels = dense
    classes = sorted(set(labels))
    piece = dict(spark.createDataFrame([(i,) for i in ids], "row_id long").select("row_id", gr.piece_of(F.col("row_id"), CFG)).collect())
    pieces, y = np.array([piece[i] for i in ids]), np.array([classes.index(c) for c in labels])
    coef, bias, step = np.zeros((x.shape[1], len(classes))), np.zeros(len(classes)), 0
    for epoch in range(CFG.sgd_epochs):
        for batch in gr.batch_order(epoch, CFG):
            own = np.isin(pieces, batch)
            g, g0, _ = plain_gradient(x[own], y[own], np.ones(own.sum()), coef, bias, "ovr")
            eta = CFG.sgd_step / np.sqrt(1 + step / CFG.sgd_batches)
            coef, bias = coef - eta * (g / own.sum() + CFG.ovr_reg_param * coef), bias - eta * g0 / own.sum()
            step += 1
    got, intercepts = gr.fit_sgd(vectors, "coarse", classes, CFG)
    np.testing.assert_allclose(np.array(got).T, coef, rtol=1e-7, atol=1e-9)
    np.testing.assert_allclose(intercepts, bias, rtol=1e-7, atol=1e-9)


def test_every_epoch_meets_every_piece_once():
    for epoch in range(3):
        assert sorted(gr.batch_order(epoch, CFG).ravel()) == list(range(CFG.sgd_batches * CFG.sgd_pieces))
    assert (gr.batch_order(0, CFG) != gr.batch_order(1, CFG)).any()


def test_certificate_tells_a_fit_from_a_bad_one(vectors):
    classes = ["DINING", "GROCERIES"]
    coef, bias = ln.fit_softmax(vectors.vectors("FOOD"), "label", classes, CFG)
    good = gr.certificate(vectors, "FOOD", "label", classes, np.asarray(coef).T, np.array(bias), "softmax", CFG)
    bad = gr.certificate(vectors, "FOOD", "label", classes, np.asarray(coef).T * 0.5, np.array(bias) + 1, "softmax", CFG)
    assert all(norm <= q.GRADIENT_SHARE * start and abs(mass - 0.5) < 0.005 for *_, mass, norm, start in good)
    assert all(norm > q.GRADIENT_SHARE * start for *_, norm, start in bad)


def test_a_batch_without_rows_changes_nothing(spark, vectors):
    none = gr.gradient(vectors.arrays().where("row_id < 0"), gr.class_number("coarse", ["a", "b"]), F.lit(1.0), np.ones((5, 2)), np.ones(2), "ovr")
    coef, bias = gr.descend(np.ones((5, 2)), np.ones(2), none, 0, CFG)
    assert (coef == 1).all() and (bias == 1).all()


def test_only_a_fitted_model_has_a_certificate(spark, sf_dir):
    model = Categorizer(CategorizerConfig(coarse_trainer="nb", fine_trainer="nb")).fit(
        q.lines(spark, sf_dir).where("row_id < 200"), label="category_id")
    assert model.certificate().count() == 0        # no logistic head
    model.trained_on = None
    with pytest.raises(ValueError, match="training rows"):
        model.certificate()
