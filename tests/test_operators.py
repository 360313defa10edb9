"""Decisions, thresholds, samples, joins and quality rules on small inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerleaf import fixed_values as fv
from ledgerleaf.config import CategorizerConfig
from ledgerleaf.operators import joins, labels, quality, reports, sampling, scoring, thresholds
from ledgerleaf.operators.taxonomy import DEFAULT_FILE, default_taxonomy, read_taxonomy
from ledgerleaf.sources import readers

CLASSES = tuple(sorted(fv.COARSE_KEYS))
CFG = CategorizerConfig()


def brute_threshold(y, p, rule):
    best = (0.50, 0.0) if rule == "v6" else (None, -1.0)
    if len(set(y)) < 2:
        return 0.50
    for t in thresholds.grid(rule):
        called = [x >= t for x in p]
        tp = sum(a and b for a, b in zip(called, y))
        if rule == "v6":
            if not any(called):
                continue
            f1 = 2 * tp / (sum(called) + sum(y))
        else:
            precision, recall = tp / max(sum(called), 1e-12), tp / max(sum(y), 1e-12)
            f1 = 2.0 * precision * recall / max(precision + recall, 1e-12)
        if f1 > best[1]:
            best = (t, f1)
    return best[0]


@pytest.mark.parametrize("rule", ["v7", "v6"])
def test_threshold_search_equals_brute_force(spark, rule):
    rng = np.random.default_rng(5)
    data, want = [], {}
    grid = thresholds.grid(rule)
    for k in range(12):
        n = int(rng.integers(1, 40))
        y = rng.integers(0, 2, n).tolist() if k != 3 else [1] * n
        p = rng.random(n).tolist() if k % 3 else rng.choice(grid, n).tolist()
        if k == 5:
            p = [0.01] * n
        if k == 6:
            p, y = [0.5] * n, [1, 0] * (n // 2) + [1] * (n % 2)
        data += [(k, int(a), float(b)) for a, b in zip(y, p)]
        want[k] = brute_threshold(y, p, rule)
    got = thresholds.threshold_search(spark.createDataFrame(data, "k int, y int, p double"), ["k"], rule=rule).collect()
    assert {r["k"]: r["threshold"] for r in got} == want


def test_grid_bin_counts_points(spark):
    points = thresholds.grid("v7")
    probes = [0.0, 0.049, 0.05, 0.5, 0.95, 1.0, *points, *[np.nextafter(x, 0) for x in points]]
    rows = spark.createDataFrame([(float(x),) for x in probes], "p double").select(
        "p", thresholds.grid_bin(F.col("p"), points).alias("b")).collect()
    assert all(r["b"] == sum(g <= r["p"] for g in points) for r in rows)


def test_floors(spark):
    df = spark.createDataFrame([("FOOD", 0.1), ("FOOD", 0.9), ("NEW", 0.1)], "cls string, threshold double")
    assert [r[1] for r in thresholds.apply_floors(df, "cls", fv.COARSE_FLOORS).collect()] == [0.22, 0.9, 0.1]


def boost(spark, text, cfg=CFG, p=None):
    p = p or [1 / 6] * 6
    df = spark.createDataFrame([(1, text, p)], "row_id int, text string, coarse_p array<double>")
    return dict(zip(CLASSES, scoring.coarse_boost(df, CLASSES, cfg).first()["boosted_p"]))


def test_boost(spark):
    out = boost(spark, "zomato uber")
    assert out["FOOD"] == pytest.approx((1 / 6 + .08) / 1.16) and out["TRAVEL"] == out["FOOD"]
    assert out["HEALTH"] == pytest.approx((1 / 6) / 1.16)
    assert boost(spark, "zomato swiggy") == boost(spark, "kfc")
    assert sum(out.values()) == pytest.approx(1.0)
    shifted = boost(spark, "amazon", CategorizerConfig(boost_alignment="positional"))
    assert max(shifted, key=shifted.get) == "OTHER_MISC"


def test_route_keeps_confidence_of_rerouted_rows(spark):
    p = [0.20, 0.16, 0.16, 0.16, 0.16, 0.16]
    df = spark.createDataFrame([(1, "x", p)], "row_id int, text string, coarse_p array<double>")
    r = scoring.route(df, CFG, CLASSES, {"FOOD": 0.22}).first()
    assert (r["coarse_top"], r["coarse_label"], r["coarse_confidence"]) == ("FOOD", "OTHER_MISC", 0.20)


def test_fine_decide_kinds(spark):
    buckets = {
        "FOOD": scoring.Bucket("fitted", ("DINING", "GROCERIES"), {"DINING": 0.9}),
        "OTHER_MISC": scoring.Bucket("fitted", ("FEES", "OTHER"), {"FEES": 0.9}),
        "HEALTH": scoring.Bucket("solo", ("HEALTH",), {"HEALTH": 0.2}), "TRAVEL": scoring.Bucket("missing"),
    }
    rows = [(1, "jio", "HEALTH", .3), (2, "jio", "TRAVEL", .3), (3, "x", "FOOD", .9), (4, "x", "OTHER_MISC", .9), (5, "jio", "OTHER_MISC", .9)]
    df = spark.createDataFrame(rows, "row_id int, text string, coarse_label string, coarse_confidence double") \
        .withColumn("fine_p_FOOD", F.array(F.lit(.8), F.lit(.2))).withColumn("fine_p_OTHER_MISC", F.array(F.lit(.7), F.lit(.3)))
    got = {r["row_id"]: r for r in scoring.fine_decide(df, CFG, buckets).collect()}
    view = {k: (r["label"], r["confidence"], r["needs_review"]) for k, r in got.items()}
    assert view == {1: ("HEALTH", 0.99, True), 2: ("OTHER", 0.0, True), 3: ("DINING", 0.8, False),
                    4: ("OTHER", 0.3, True), 5: ("UTILITIES_TELECOM", 0.3, True)}
    assert got[5]["label_raw"] == "OTHER" and got[1]["rule"] is None


def test_later_filter_on_predictions_plans_quickly(spark):
    df = spark.range(50).select(F.col("id").alias("row_id"), F.lit("jio").alias("text"),
                                F.array(*[F.rand(1) for _ in CLASSES]).alias("coarse_p"))
    out = scoring.route(df, CFG, CLASSES, {}).where("coarse_confidence < 0.5 and coarse_label = 'FOOD'")
    assert out.count() >= 0


@pytest.mark.parametrize("sizes", [(0, 10), (10, 0), (333, 200), (1000, 5), (5000, 5000)])
def test_hash_bands_equal_global_order(spark, sizes):
    import hashlib
    df = spark.range(1000).withColumnRenamed("id", "row_id")
    got = {r["row_id"]: r["band"] for r in sampling.train_test_split(df, "row_id", *sizes).collect()}
    order = sorted(range(1000), key=lambda k: hashlib.md5(f"{k}:42".encode()).hexdigest())
    want = {k: "train" for k in order[:sizes[0]]} | {k: "test" for k in order[sizes[0]:sum(sizes)]}
    assert got == want


def test_allocation_adds_up(spark):
    df = spark.createDataFrame([(x,) for x in ("DINING", "FEES", "ZZZ", "FUEL")], "label string")
    assert sum(r["quota"] for r in sampling.label_allocation(df, "label", 101).collect()) == 101


def test_salted_join_equals_broadcast_join(spark):
    left = spark.range(500).select(F.col("id").alias("row_id"), F.when(F.col("id") < 400, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 7)).alias("term"))
    right = left.select("term").distinct().withColumn("v", F.length("term"))
    small = joins.join_bounded(left, right, "term", max_rows=10, row_bytes=10, spread_by="row_id")
    large = joins.join_bounded(left, right, "term", max_rows=10, row_bytes=10, spread_by="row_id", limit=0)
    assert sorted(small.collect()) == sorted(large.select(*small.columns).collect())
    for how in ("left", "inner"):
        some = right.where("term != 'k1'")
        a = left.join(some, "term", how).select("row_id", "term", "v").collect()
        b = joins.join_skewed(left, some, "term", how, spread_by="row_id").select("row_id", "term", "v").collect()
        assert sorted(map(str, a)) == sorted(map(str, b))


def test_duplicates_with_a_hot_key(spark):
    df = spark.range(3000).select(F.col("id").alias("row_id"), F.when(F.col("id") < 1000, "same").otherwise(F.col("id").cast("string")).alias("transaction_id"))
    out = quality.duplicate_rules(df)
    assert out.count() == 3000 and out.where("duplicate").count() == 1000
    assert {r["copies"] for r in out.where("duplicate").select("copies").distinct().collect()} == {1000}


def test_pick_columns(spark):
    df = spark.createDataFrame([("a", "b", "c")], "narrative string, category_display_name string, category_id string")
    assert labels.pick_columns(df) == ("narrative", "category_id")
    assert labels.pick_columns(df.drop("category_id")) == ("narrative", "category_display_name")
    with pytest.raises(ValueError, match="available"):
        labels.pick_columns(df.select("narrative"))


def test_report_with_unpredicted_label(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("c", "b")], "t string, p string")
    rows = {r["label"]: r for r in reports.classification_report(df, "t", "p").collect()}
    assert rows["b"]["precision"] == 0.0 and rows["b"]["support"] == 0
    assert rows["accuracy"]["f1"] == pytest.approx(1 / 3, abs=1e-6)


def test_taxonomy_file(spark):
    read, shipped = read_taxonomy(spark, str(DEFAULT_FILE), multi_line=True), default_taxonomy(spark)
    assert read.schema == shipped.schema
    key = lambda r: r["id"]
    assert [tuple(r)[:3] for r in sorted(read.collect(), key=key)] == [tuple(r)[:3] for r in sorted(shipped.collect(), key=key)]


def test_argument_checks(spark):
    with pytest.raises(ValueError):
        CategorizerConfig(low_conf=1.5)
    with pytest.raises(ValueError):
        readers.require_csv("input.parquet")
    with pytest.raises(ValueError):
        readers.texts(spark, [])
    with pytest.raises(ValueError, match="available"):
        readers.non_blank(spark.range(1), "missing")


def test_dirty_cells_turn_null(spark):
    raw = spark.createDataFrame([("2024-13-01", "2024-01-02", "12,5")], "value_date string, posted_at string, amount string")
    r = readers.typed_transactions(raw).first()
    assert r["value_date"] is None and r["amount"] is None and str(r["posted_at"]) == "2024-01-02"
