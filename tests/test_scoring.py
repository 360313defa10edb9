"""Scoring row by row, readers that agree, and the jobs."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from ledgerleaf.config import CategorizerConfig
from ledgerleaf.operators import features as ft
from ledgerleaf.operators import labels as lb
from ledgerleaf.operators import linear as ln
from ledgerleaf.operators import reports as rp
from ledgerleaf.operators import scoring as sc
from ledgerleaf.operators import thresholds as th
from ledgerleaf.plans import jobs
from ledgerleaf.plans import queries as q
from ledgerleaf.plans.categorizer import CategorizerModel
from ledgerleaf.sources import readers, writers
from ledgerleaf.streaming import scoring as st


@pytest.fixture(scope="module")
def model(spark, sf_dir):
    return q.nb_model(spark, sf_dir)


def test_equal_and_null_ids_score_like_unique_ones(spark, model):
    texts = ["UPI zomato dinner", "electricity bill airtel", None, "hpcl fuel pump", "UPI zomato dinner"]
    key = lambda df: [tuple(r)[1:] for r in df.orderBy("n").collect()]
    rows = [(n, t) for n, t in enumerate(texts)]
    unique = spark.createDataFrame([(n, n, t) for n, t in rows], "n long, row_id long, text string")
    clash = spark.createDataFrame([(n, None if n % 2 else 1, t) for n, t in rows], "n long, row_id long, text string")
    drop = lambda df: model.transform(df, explain=True).drop("row_id")
    assert key(drop(unique)) == key(drop(clash))


@pytest.mark.parametrize("explain", [False, True])
def test_scoring_has_no_exchange_and_one_scan(spark, sf_dir, model, explain):
    plan = model.transform(q.lines(spark, sf_dir).select("text"), explain=explain)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("FileScan") == 1


def test_a_model_of_several_blocks_answers_like_one_block(spark, sf_dir, model, monkeypatch):
    rows = q.lines(spark, sf_dir).select("row_id", "text").unionByName(
        spark.createDataFrame([(-1, None), (-2, ""), (-2, "nothing known zzzzqqqq")], "row_id long, text string"))
    whole = model.transform(rows, explain=True, low_conf=1.0, details=True).collect()
    monkeypatch.setattr(sc, "MODEL_LIMIT_BYTES", (ft.TERM_BYTES + 8 * model.width) * (model.terms.count() // 5 + 1))
    split = CategorizerModel(model.cfg, model.terms, model.heads, model.buckets, model.coarse_thresholds)
    assert len(split.ranges) == 5 and split.table is None
    assert sorted(map(str, split.transform(rows, explain=True, low_conf=1.0, details=True).collect())) == sorted(map(str, whole))
    assert sum(r["explanation"] is not None for r in whole) > 100
    monkeypatch.setattr(ft.vectorize, "__kwdefaults__", ft.vectorize.__kwdefaults__ | {"limit": 0})  # not even the terms' names
    assert sorted(map(str, split.transform(rows, explain=True, low_conf=1.0, details=True).collect())) == sorted(map(str, whole))


def test_quoted_line_break_is_one_row_in_batch_and_stream(spark, model, tmp_path):
    rows = spark.createDataFrame([(1, "UPI zomato\ndinner"), (2, 'say "hi", fuel')], "row_id long, text string")
    writers.write_csv(rows.coalesce(1), str(tmp_path / "in"))
    batch = readers.read_csv(spark, str(tmp_path / "in"), rows.schema, multi_line=True)
    assert sorted(map(tuple, batch.collect())) == sorted(map(tuple, rows.collect()))
    stream = readers.read_csv_stream(spark, str(tmp_path / "in"), rows.schema, multi_line=True)
    for _ in range(2):                       # a second start finds nothing new
        st.score_stream(stream, model, str(tmp_path / "out"), str(tmp_path / "state"), text="text").awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, model.transform(rows).collect()))


def test_large_csv_file_is_split(spark, tmp_path):
    writers.write_csv(spark.range(20_000).selectExpr("cast(id as string) AS a", "repeat('x', 40) AS b").coalesce(1), str(tmp_path / "c"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        table = readers.read_csv(spark, str(tmp_path / "c"), spark.createDataFrame([], "a string, b string").schema)
        assert table.rdd.getNumPartitions() > 4 and table.count() == 20_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_own_hierarchy_guesses_missing_labels(spark):
    names = ["GROCERIES", "FUEL", "HEALTH", "ENTERTAINMENT", "UTILITIES_X", "EDUCATION", "NEW"]
    df = spark.createDataFrame([(n,) for n in names], "label string")
    got = {r["label"]: r["c"] for r in df.select("label", lb.coarse_of(F.col("label"), {"FOOD": ["DINING"]}).alias("c")).collect()}
    assert got == {"GROCERIES": "FOOD", "FUEL": "TRAVEL", "HEALTH": "HEALTH", "ENTERTAINMENT": "SHOPPING",
                   "UTILITIES_X": "UTILITIES", "EDUCATION": "SHOPPING", "NEW": "OTHER_MISC"}


def test_two_classes_are_penalised_like_a_binary_fit(spark):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(60, 4)), rng.integers(0, 2, 60)
    table = spark.createDataFrame([(float(v), "ab"[v], Vectors.dense(r.tolist())) for r, v in zip(x, y)], ["y", "label", "features"])
    cfg = CategorizerConfig(fine_tol=1e-10)
    coef, _ = ln.fit_softmax(table, "label", ["a", "b"], cfg)
    n = len(y)
    weights = table.withColumn("w", F.when(F.col("y") == 1, n / (2.0 * y.sum())).otherwise(n / (2.0 * (n - y.sum()))))
    binary = LogisticRegression(family="binomial", labelCol="y", weightCol="w", standardization=False, tol=1e-10, maxIter=500,
                                regParam=1.0 / (cfg.inverse_regularisation * n)).fit(weights)
    np.testing.assert_allclose(coef[1] - coef[0], binary.coefficients.toArray(), rtol=1e-4)


def test_iteration_limit_warns(spark):
    table = spark.createDataFrame([("ab"[i % 2], Vectors.dense([float(i), 1.0 / (i + 1)])) for i in range(20)], ["label", "features"])
    with pytest.warns(UserWarning, match="max_iter"):
        ln.fit_softmax(table, "label", ["a", "b"], CategorizerConfig(max_iter=1))


def test_confusion_axis_is_the_union(spark):
    df = spark.createDataFrame([("a", "b"), ("c", "a"), ("a", "a")], "t string, p string")
    wide = rp.confusion_wide(df, "t", "p", ["a"])
    assert wide.columns == ["truth", "a", "b", "c"]
    assert [tuple(r) for r in wide.collect()] == [("a", 1, 1, 0), ("b", 0, 0, 0), ("c", 1, 0, 0)]


def test_v6_takes_its_own_fine_floors():
    assert CategorizerConfig(threshold_rule="v6").effective_fine_floors["SHOPPING_ECOM"] == 0.25
    assert CategorizerConfig().effective_fine_floors["SHOPPING_ECOM"] == 0.30


def test_oracle_grid_is_the_grid():
    from oracles.sql import grid
    assert all(grid(rule) == pytest.approx(th.grid(rule), abs=0) for rule in ("v6", "v7"))


def test_evaluate_and_predict_jobs(spark, sf_dir, tmp_path):
    rows = q.lines(spark, sf_dir).select("narrative", "category_id", "split")
    for part in ("train", "test"):
        rows.where(F.col("split") == part).drop("split").write.parquet(str(tmp_path / part))
    out = str(tmp_path / "reports")
    cfg = CategorizerConfig(coarse_trainer="nb", fine_trainer="nb")
    metrics = jobs.evaluate(spark, str(tmp_path / "train"), str(tmp_path / "test"), str(tmp_path / "m"), out, cfg)
    n = rows.where("split = 'test' and category_id is not null").count()
    assert metrics["n_test"] == n and metrics["accuracy"] > 0.8 and metrics["throughput_tx_per_s"] > 0
    read = lambda name: spark.read.option("header", True).csv(f"{out}/{name}")
    assert read("preds_test").columns == ["raw_text", "__weight__", "label", "pred", "pred_proba", "explain"]
    assert read("preds_test").count() == n
    assert read("confusion_matrix").count() == len(read("confusion_matrix").columns) - 1
    assert read("report").where("label = 'macro avg'").count() == 1
    jobs.predict(spark, str(tmp_path / "m"), str(tmp_path / "p"), texts=["UPI zomato dinner", "fuel"])
    assert spark.read.text(str(tmp_path / "p")).count() == 2
    (tmp_path / "t.txt").write_text(" one \n\n two\n")
    jobs.predict(spark, str(tmp_path / "m"), str(tmp_path / "d"), lines=str(tmp_path / "t.txt"), display=True)
    assert spark.read.option("header", True).csv(str(tmp_path / "d")).count() == 2
    with pytest.raises(ValueError, match="exactly one"):
        jobs.predict(spark, str(tmp_path / "m"), str(tmp_path / "x"))


def test_both_levels_of_thresholds_score_a_line_once(spark, sf_dir):
    from ledgerleaf.operators import thresholds as th
    from ledgerleaf.plans import queries as q

    both = q.QUERIES["threshold_search"](spark, sf_dir)
    assert both._jdf.queryExecution().executedPlan().toString().count("dot(") == 1
    alone = [th.threshold_search(q._pairs(spark, sf_dir, level), ["level", "bucket", "cls"]) for level in ("coarse", "fine")]
    keys = ["level", "bucket", "cls", "positives", "n"]
    assert sorted(both.select(keys).collect()) == sorted(alone[0].unionByName(alone[1]).select(keys).collect())
