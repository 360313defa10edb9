"""Terms counted as arrays against a plain loop, with ids that repeat or are null, and what the plans hold."""

import collections
import math

from ledgerleaf.config import CategorizerConfig
from ledgerleaf.operators import features as ft
from ledgerleaf.operators import grams as gm
from ledgerleaf.operators import naive_bayes as nb

CFG = CategorizerConfig(word_min_df=1, char_min_df=1, stop_tokens=("stop",), word_ngrams=(1, 3), char_ngrams=(3, 9))
ROWS = [(1, "Ab c zomato DINNER"), (2, None), (3, ""), (4, "a b"), (5, "extraordinarily long stop words words words"),
        (6, "pune 12345 x9"), (6, "pune zomato"), (None, "ab zomato"), (None, "dinner dinner"), (7, "ab" * 9)]


def terms(text):
    toks = [t for t in (text or "").lower().replace("12345", " ").split() if t != "stop"]
    words = [t for t in toks if len(t) > 1]
    out = ["w__" + " ".join(words[i: i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]
    for t in toks:
        out += ["c__" + f" {t} "[i: i + n] for n in range(3, 10) for i in range(len(t) + 3 - n)]
    return collections.Counter(out)


def counts():
    per = collections.defaultdict(collections.Counter)
    for k, text in ROWS:
        per[k] += terms(text)
    return per


def test_terms_are_those_of_a_loop(spark, monkeypatch):
    df = spark.createDataFrame(ROWS, "row_id long, text string")
    want = {(k, t): n for k, own in counts().items() for t, n in own.items()}
    for size in (gm.CHUNK_BYTES, 20):
        monkeypatch.setattr(gm, "CHUNK_BYTES", size)
        got = {(r.row_id, r.term): r.tf for r in ft.term_freq(ft.keyed(df, "row_id", "text"), CFG).collect()}
        assert got == want
    stats = {r.term: (r.df, r.total) for r in ft.fit_vocabulary(df, CFG).collect()}
    assert stats == {t: (sum(t in c for c in counts().values()), sum(c[t] for c in counts().values())) for _, t in want}


def test_weights_are_the_same_by_row_and_by_join(spark):
    df = spark.createDataFrame(ROWS, "row_id long, text string")
    vocab = ft.fit_vocabulary(df, CFG)
    idf = {r.term: r.idf for r in vocab.collect()}
    plain = {}
    for k, own in counts().items():
        weight = {t: (1 + math.log(n) if t[0] == "w" else n) * idf[t] for t, n in own.items()}
        for t, x in weight.items():
            plain[k, t] = round(x / math.sqrt(sum(y * y for u, y in weight.items() if u[0] == t[0])), 9)
    rows = ft.keyed(df, "row_id", "text")
    for tf, limit in ((ft.term_freq(rows, CFG), None), (ft.term_freq(rows, CFG, grouped=True), None), (ft.term_freq(rows, CFG, grouped=True), 0)):
        assert {(r.row_id, r.term): round(r.value, 9) for r in ft.tfidf(tf, vocab, CFG, limit=limit).collect()} == plain


def test_rows_of_their_own_are_not_aggregated(spark):
    df = spark.createDataFrame([(1, "zomato dinner"), (2, "pune ride")], "row_id long, text string")
    rows = ft.keyed(df, "row_id", "text")
    assert "Aggregate" not in ft.term_freq(rows, CFG)._jdf.queryExecution().executedPlan().toString()
    weighed = ft.tfidf(ft.term_freq(rows, CFG, grouped=True), ft.fit_vocabulary(df, CFG), CFG)
    plan = weighed._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Join" not in plan


def test_class_sums_of_arrays_and_of_entries(spark, monkeypatch):
    rows = spark.createDataFrame([("a", ([0, 2], [1.0, 2.0])), ("b", ([2], [4.0])), ("a", ([2], [0.5])), ("a", ([], []))],
                                 "label string, features struct<indices:array<int>,values:array<double>>").coalesce(1)
    for held in (nb.HELD_SUMS, 1):
        monkeypatch.setattr(nb, "HELD_SUMS", held)
        got = {r.idx: r.sums for r in nb.class_sums(rows, "label", ["a", "b"]).collect()}
        assert got == {0: [1.0, 0.0], 2: [2.5, 4.0]}


def test_documents_are_counted_where_their_terms_are_laid_out(spark, monkeypatch):
    df = spark.createDataFrame(ROWS, "row_id long, text string")
    for held in (gm.HELD_TERMS, 1):
        monkeypatch.setattr(gm, "HELD_TERMS", held)
        for rows in (df, df.where("row_id < 6")):
            rows = ft.keyed(rows, "row_id", "text")
            for branches in (ft.BRANCHES, ("w",), ("c",)):
                want = ft.doc_freq(ft.term_freq(rows, CFG, branches=branches)).collect()
                stats = ft.doc_freq(ft.term_freq(rows, CFG, branches=branches, grouped=True), CFG, branches)
                assert sorted(stats.collect()) == sorted(want)


def test_counts_of_terms_are_made_once_for_all_cuts(spark):
    seen = spark.sparkContext.accumulator(0)
    stats = spark.createDataFrame([("w__ab", 2, 3), ("w__cd", 2, 3), ("c__ab ", 1, 1)], "term string, df long, total long") \
        .mapInArrow(lambda batches: (seen.add(b.num_rows) or b for b in batches), "term string, df long, total long")
    assert ft.vocabulary(stats, CFG).count() == 3
    assert seen.value == 3
