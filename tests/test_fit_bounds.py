"""What bounds the logistic fits: tasks of a step, coefficients that the driver holds, rows that a gradient sends."""

import threading
import time

import numpy as np
from pyspark.sql import functions as F

from ledgerleaf.operators import gradients as gr
from ledgerleaf.operators import linear as ln


def test_tasks_of_a_step_are_bounded_by_the_cores():
    assert [ln.tasks_for(n, 12) for n in (0, 10_000_000, 1_000_000_000)] == [1, 6, 36]
    assert ln.tasks_for(6_000_000_000, 12) == 121


def test_fits_wait_for_room(monkeypatch):
    monkeypatch.setattr(ln, "COEFFICIENTS_AT_ONCE", 10)
    lock, running, most = threading.Lock(), [], []

    def job(size):
        def run():
            with lock:
                running.append(size)
                most.append(sum(running))
            time.sleep(0.05)
            with lock:
                running.remove(size)
            return size
        return run

    sizes = [4, 25, 4, 4, 6, 10]
    assert ln.fit_many([job(n) for n in sizes], sizes) == sizes
    assert all(x <= 10 or x == 25 for x in most)


def test_a_task_sends_each_feature_once(spark, monkeypatch):
    monkeypatch.setattr(gr, "STEP_ROWS", 7)
    monkeypatch.setattr(gr, "SENT_ROWS", 3)
    rows = spark.range(0, 500, 1, 2).select(
        F.array(F.lit(0), (F.col("id") % 9 + 1).cast("int")).alias("indices"), F.array(F.lit(1.0), F.lit(2.0)).alias("values"),
        (F.col("id") % 3).alias("y")).select(F.struct("indices", "values").alias("features"), "y")
    coef, bias = np.arange(30.0).reshape(10, 3) / 30, np.array([0.1, 0.0, -0.1])
    g = gr.gradient(rows, F.col("y"), F.lit(2.0), coef, bias, "softmax")
    want, off = np.zeros((10, 3)), np.zeros(3)
    for i in range(500):
        x = np.zeros(10)
        x[0], x[i % 9 + 1] = 1, 2
        d = gr.link_of((x @ coef + bias)[None], "softmax")[0]
        d[i % 3] -= 1
        want, off = want + 2 * np.outer(x, d), off + 2 * d
    assert np.allclose(g.features, want) and np.allclose(g.intercepts, off) and g.weight == 1000
    assert np.isclose(g.mass.sum(), 1000)
