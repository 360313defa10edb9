"""Range joins, copies, closures and published tables against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerleaf.operators import joins as jn
from ledgerleaf.operators import quality as dq
from ledgerleaf.operators import reports as rp
from ledgerleaf.operators import taxonomy as ta
from ledgerleaf.plans import queries as q
from ledgerleaf.sources import readers, writers
from ledgerleaf.streaming import scoring as st


@pytest.mark.parametrize("limit", [jn.BROADCAST_ROWS, 0])
def test_range_join_equals_all_pairs(spark, monkeypatch, limit):
    rng = random.Random(2)
    points = [(i, rng.choice(["a", "b", None]), rng.choice([None, 0.0, 1.0, 8.0, -8.0, rng.uniform(-300, 300), rng.uniform(0, 2)])) for i in range(400)]
    points += [(i, "hot", 7.5) for i in range(400, 900)]
    ranges = [("a", 1, None, 0.0), ("a", 2, 0.0, 8.0), ("a", 3, 8.0, None), ("b", 4, -8.0, 250.5), ("b", 5, 1.0, 1.0), ("c", 6, None, None),
              (None, 7, 0.0, 9.0), ("hot", 8, 7.0, 8.0), ("hot", 9, None, None)]
    monkeypatch.setattr(jn.few, "__defaults__", (limit,))
    got = jn.range_join(spark.createDataFrame(points, "id long, k string, v double"),
                        spark.createDataFrame(ranges, "k string, no long, low double, high double"), "v", "low", "high", ["k"])
    want = []
    for i, k, v in points:
        own = [n for rk, n, lo, hi in ranges if k is not None and rk == k and v is not None and (lo is None or lo <= v) and (hi is None or v < hi)]
        want += [(i, n) for n in own or [None]]
    order = lambda rows: sorted(rows, key=lambda r: (r[0], r[1] or 0))
    assert got.columns == ["id", "k", "v", "no", "low", "high"]
    assert order([(r.id, r.no) for r in got.collect()]) == order(want)


def test_bands_need_no_nested_loop(spark, sf_dir):
    plan = q.QUERIES["dq_amount_bands"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    odd = spark.createDataFrame([(1, "no such label", 200.0), (2, None, 200.0), (3, "FEES", None)], "row_id long, category_id string, amount double")
    assert {r.row_id: r.band for r in dq.amount_bands(odd, dq.limit_bands(spark)).collect()} == {1: "lower", 2: "lower", 3: None}


@pytest.mark.parametrize("limit", [jn.BROADCAST_ROWS, 0])
def test_copies(spark, monkeypatch, limit):
    monkeypatch.setattr(jn, "COPIES_A_TASK", 50)
    rows = [(i, "hot" if i % 3 else None if i % 2 else f"k{i // 12}") for i in range(600)]
    got = jn.with_copies(spark.createDataFrame(rows, "id long, k string"), "k", "id", limit=limit).collect()
    keys = [k for _, k in rows]
    assert sorted((r.id, r.copies) for r in got) == [(i, keys.count(k) if k is not None else 1) for i, k in rows]


def test_copies_count_once(spark, sf_dir):
    plan = q.QUERIES["dq_duplicates"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and plan.count("Join") == 2     # one of them makes the lines


def test_closure_of_chains_branches_and_cycles(spark):
    edges = [(f"n{i}", f"n{i + 1}") for i in range(11)] + [("x", "n3"), ("x", "n9"), ("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("e", None), ("f", "f")]
    parents = {}
    for a, b in edges:
        if b:
            parents.setdefault(a, set()).add(b)
    want = {}
    for node in parents:
        level, at, seen = 1, parents[node], {}
        while at - seen.keys():
            seen |= {p: level for p in at - seen.keys()}
            at, level = {g for p in at for g in parents.get(p, ())}, level + 1
        want |= {(node, p): n for p, n in seen.items()}
    paths = ta.closure(spark.createDataFrame(edges, "node string, parent string"))
    assert {(r.node, r.ancestor): r.distance for r in paths.collect()} == want
    assert {tuple(r) for r in ta.cycles(paths).collect()} == {("a", 3), ("b", 3), ("c", 3), ("f", 1)}
    assert ta.closure(spark.createDataFrame([], "node string, parent string")).count() == 0


def test_rollup_counts_a_fact_once_for_each_ancestor(spark):
    paths = ta.closure(spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "b"), ("c", "a")], "node string, parent string"))
    facts = spark.createDataFrame([("a", 1), ("c", 10), ("c", 10), ("z", 5)], "node string, v long")
    got = {r.ancestor: (r.total_rows, r.v) for r in ta.rollup(facts, "node", paths, "v").collect()}
    assert got == {"a": (3, 21), "b": (3, 21), "c": (2, 20), "z": (1, 5)}


def test_published_totals_survive_replay_and_broken_writes(spark, tmp_path):
    out = str(tmp_path / "totals")
    with pytest.raises(ValueError, match="nothing"):
        st.read_published(spark, out)
    table = lambda n: spark.createDataFrame([("x", n)], "label string, total_rows long")
    seen = []
    for batch, n in [(0, 5), (1, 9), (1, 9), (2, 11)]:       # batch 1 is replayed
        st.publish(table(n), batch, out)
        seen.append([tuple(r) for r in st.read_published(spark, out).collect()])
        (tmp_path / "totals" / f"batch-{batch + 1:012d}-broken").mkdir(exist_ok=True)   # a write that never ended
    assert seen == [[("x", 5)], [("x", 9)], [("x", 9)], [("x", 11)]]
    assert not list((tmp_path / "totals").glob("batch-000000000000-*"))


def test_a_reader_sees_a_table_while_the_next_is_written(spark, tmp_path, monkeypatch):
    out = str(tmp_path / "totals")
    st.publish(spark.range(3).toDF("x"), 0, out)
    real, during = st.uuid.uuid4, []

    def watched():
        during.append(st.read_published(spark, out).count())
        return real()

    monkeypatch.setattr(st.uuid, "uuid4", watched)
    st.publish(spark.range(4).toDF("x"), 1, out)
    assert during == [3] and st.read_published(spark, out).count() == 4


def test_streams_report_progress(spark, sf_dir, tmp_path):
    rows = q.lines(spark, sf_dir).select("row_id", "narrative")
    writers.write_csv(rows, str(tmp_path / "in"))
    model = q.nb_model(spark, sf_dir)
    stream = readers.read_csv_stream(spark, str(tmp_path / "in"), rows.schema)
    run = st.score_stream(stream, model, str(tmp_path / "out"), str(tmp_path / "state"), text="narrative")
    run.awaitTermination()
    done = spark.read.parquet(str(tmp_path / "out"))
    assert sum(n for _, n, _ in st.progress(run)) == rows.count()
    assert sum(n for *_, n in st.progress(run)) == done.where(F.col("needs_review")).count()


def test_a_confusion_matrix_has_a_bound(spark):
    rows = spark.range(50).select(F.col("id").cast("string").alias("truth"), F.lit("a").alias("pred"))
    assert len(rp.confusion_wide(rows, "truth", "pred").columns) == 52
    with pytest.raises(ValueError, match="distinct labels"):
        rp.confusion_wide(rows, "truth", "pred", max_labels=20)
