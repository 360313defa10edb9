"""Every registered query against its SQL counterpart, on whole tables."""

import re
import time

import pytest
from compare import connect, differences

import __spark_entry__ as entry

QUERIES = {name: q for name, q in entry.queries().items() if not re.match(r"op\d+_|pipeline$", name)}
SQL = {name: sql for name, sql in entry.oracle_sql().items() if name in QUERIES}


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_query_has_an_oracle():
    assert set(SQL) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf_dir, con, name):
    assert differences(QUERIES[name](spark, sf_dir), con, SQL[name]) == []


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_metrics_sink_times_the_scoring(spark, sf_dir, monkeypatch):
    from ledgerleaf.plans import queries as q
    q.scored(spark, sf_dir).count()  # stored, so that reading it again is no scoring
    seen, real = [], q.CategorizerModel.transform
    summary = q.rp.metrics_summary

    def slow(self, *args, **options):
        time.sleep(1)
        return real(self, *args, **options)

    monkeypatch.setattr(q.CategorizerModel, "transform", slow)
    monkeypatch.setattr(q.rp, "metrics_summary", lambda *a: seen.append(a[-1]) or summary(*a))
    assert q.QUERIES["metrics_sink"](spark, sf_dir).first().timed and seen[0] > 1
