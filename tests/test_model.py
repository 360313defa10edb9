"""Properties of fitted models."""

import numpy as np
import pytest
from pyspark.ml.classification import NaiveBayes
from pyspark.sql import functions as F

from ledgerleaf.config import CategorizerConfig
from ledgerleaf.operators import features as ft
from ledgerleaf.operators import linear as ln
from ledgerleaf.operators import naive_bayes as nb
from ledgerleaf.plans import jobs
from ledgerleaf.plans import queries as q
from ledgerleaf.plans.categorizer import Categorizer, CategorizerModel
from ledgerleaf.sources import readers, writers


def test_closed_form_equals_library_naive_bayes(spark, sf_dir):
    cfg = CategorizerConfig()
    rows = q.lines(spark, sf_dir).where("channel = 'CARD'").select("row_id", "text", F.col("true_label").alias("label"))
    names = sorted(r["label"] for r in rows.select("label").distinct().collect())
    vocab = ft.fit_vocabulary(rows, cfg)
    vectors = ln.Vectors(ft.vectorize(rows, vocab, cfg), names, vocab.count(), columns=("row_id", "label"), bucket="label")
    sums = nb.class_sums(vectors.values("label"), "label", names)
    own = nb.complement_weights(sums, [[[i] for i in range(len(names))]], 0.5).collect()
    table = ln._indexed(vectors.vectors(), "label", names)
    theta = NaiveBayes(modelType="complement", smoothing=0.5, labelCol="__y").fit(table).theta.toArray()
    mine = np.zeros_like(theta)
    for r in own:
        mine[:, r["idx"]] = r["w"]
    np.testing.assert_allclose(np.abs(theta), mine, rtol=1e-9)


def test_vectors_do_not_depend_on_the_vocabulary_size_limit(spark, sf_dir):
    cfg = CategorizerConfig()
    rows = q.lines(spark, sf_dir).select("row_id", "text")
    vocab = ft.fit_vocabulary(rows, cfg)
    held, joined = (dict(ft.vectorize(rows, vocab, cfg, limit=n).select("row_id", "features").collect()) for n in (1 << 28, 0))
    assert held.keys() == joined.keys() and len(held) == rows.count()
    for k, v in held.items():
        assert list(v["indices"]) == list(joined[k]["indices"])
        np.testing.assert_allclose(v["values"], joined[k]["values"], rtol=1e-12)


@pytest.fixture(scope="module")
def model(spark, sf_dir):
    return q.nb_model(spark, sf_dir)


def test_probabilities_sum_to_one(spark, sf_dir, model):
    p = model.probabilities(q.lines(spark, sf_dir))
    off = F.abs(F.aggregate("coarse_p", F.lit(0.0), lambda a, x: a + x) - 1.0)
    assert p.agg(F.max(off)).first()[0] < 1e-5


def test_thresholds_reach_floors(model):
    assert all(t >= model.cfg.coarse_floors.get(c, 0) for c, t in model.coarse_thresholds.items())
    for b in model.fitted_buckets:
        assert all(t >= model.cfg.effective_fine_floors.get(c, 0) for c, t in model.buckets[b].thresholds.items())


def test_partition_count_does_not_matter(spark, sf_dir, model):
    rows = q.lines(spark, sf_dir).select("row_id", "text")
    key = lambda df: sorted(map(tuple, df.collect()))
    first = key(model.transform(rows))
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert key(model.transform(rows.repartition(5))) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_null_and_empty_text_keep_their_rows(spark, model):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "UPI 12345")], "row_id long, text string")
    out = model.transform(df).collect()
    assert len(out) == 3 and len({(r["label"], r["confidence"]) for r in out}) == 1


def test_unknown_text_column(spark, model):
    with pytest.raises(ValueError, match="available"):
        model.transform(spark.range(1), text="narrative")


def test_full_model_trains_and_survives_saving(spark, sf_dir, tmp_path):
    cfg = CategorizerConfig(max_iter=15, calibrate_on="holdout")
    rows = q.lines(spark, sf_dir)
    model = Categorizer(cfg).fit(rows.where("split = 'train'"), label="category_id")
    model.save(str(tmp_path / "m"))
    again = CategorizerModel.load(spark, str(tmp_path / "m"))
    sample = rows.where("split = 'test'")
    a = model.transform(sample.select("row_id", "text", "true_label"), explain=True, details=True)
    b = again.transform(sample.select("row_id", "text", "true_label"), explain=True, details=True)
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    right = a.agg(F.avg((F.col("label_raw") == F.col("true_label")).cast("int"))).first()[0]
    assert right > 0.9
    shown = [r for r in a.collect() if r["explanation"]]
    assert all(r["needs_review"] and len(r["explanation"].split("; ")) <= 6 for r in shown)


def test_one_vs_rest_router(spark, sf_dir):
    cfg = CategorizerConfig(coarse_trainer="ovr", fine_trainer="nb", max_iter=5)
    rows = q.lines(spark, sf_dir)
    model = Categorizer(cfg).fit(rows.where("split = 'train'"), label="category_id")
    off = F.abs(F.aggregate("coarse_p", F.lit(0.0), lambda a, x: a + x) - 1.0)
    assert model.probabilities(rows).agg(F.max(off)).first()[0] < 1e-5


def test_score_job(spark, sf_dir, model, tmp_path):
    model.save(str(tmp_path / "m"))
    source = str(tmp_path / "in.csv")
    writers.write_csv(q.lines(spark, sf_dir).select("transaction_id", "narrative"), source)
    jobs.score(spark, str(tmp_path / "m"), source, str(tmp_path / "out"), "narrative")
    out = spark.read.option("header", True).csv(str(tmp_path / "out"))
    assert out.columns == ["transaction_id", "narrative", "label", "confidence", "coarse_label", "coarse_confidence", "needs_review"]
    assert out.count() == q.lines(spark, sf_dir).count()
    with pytest.raises(ValueError, match="available"):
        jobs.score(spark, str(tmp_path / "m"), source, str(tmp_path / "out2"), "missing")


def test_empty_review_queue_is_not_written(spark, tmp_path):
    empty = spark.createDataFrame([], "raw_text string, label string")
    assert writers.write_review_queue(empty, str(tmp_path / "q")) is False
    assert not (tmp_path / "q").exists()


def test_text_file_source(spark, tmp_path):
    (tmp_path / "t.txt").write_text(" one \n\n two\n")
    assert sorted(r["text"] for r in readers.read_text_lines(spark, str(tmp_path / "t.txt")).collect()) == ["one", "two"]
