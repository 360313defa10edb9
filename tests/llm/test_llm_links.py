"""Rounds of linking start from the components found so far."""

from itertools import combinations

from pyspark.sql import functions as F

from ledgerleaf.llm import components as cc


def test_a_round_takes_up_components_not_their_links(spark, monkeypatch):
    given, find = [], cc.components

    def counted(edges):
        given.append(edges.count())
        return find(edges)

    monkeypatch.setattr(cc, "components", counted)
    known = spark.createDataFrame(list(combinations(range(30), 2)) + [(100, 101)], "a long, b long")
    lists = spark.createDataFrame([(1, 0), (1, 100), (1, 200), (2, 5), (2, 300)], "key long, id long")
    found = cc.link_lists(lists, F.lit(True), lambda pairs: pairs.where("a < 200 and b < 250"), [], pivots=3, known=known)
    assert given[0] == 436 and max(given[1:]) <= 40
    want = {(i, 0) for i in [*range(1, 30), 100, 101, 200]}
    assert {(r.id, r.component) for r in found.collect()} == want
