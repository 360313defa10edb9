"""Thresholds of the language stage come from all learning documents."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as cp
from ledgerleaf.llm import language_id


def test_thresholds_come_from_all_documents(spark, monkeypatch):
    def predict(docs, profiles, score_out):
        return docs.withColumn(score_out, F.pmod(F.xxhash64("text"), F.lit(1_000_003)) / 1_000_003)

    monkeypatch.setattr(language_id, "predict", predict)
    monkeypatch.setattr(cp, "CLASSES", range(3, 4))
    docs = spark.range(9_000).select(F.concat(F.lit("abcdefghij"), F.translate(F.col("id").cast("string"), "0123456789", "klmnopqrst")).alias("text"),
                                     F.lit("en").alias("lang"))
    # one class: the texts and their first 12 letters
    own = docs.select(F.explode(F.array_distinct(F.array("text", F.substring("text", 1, 12)))).alias("text"))
    scores = sorted(r.s for r in predict(own, None, "s").collect())
    monkeypatch.setattr(cp, "SHARE", 1.0)
    monkeypatch.setattr(cp, "NOISE", 0.0)
    [least] = cp.least_scores(docs, {})
    assert abs(np.searchsorted(scores, least) - 0.01 * len(scores)) <= 3


def test_slabs_hold_every_text():
    import pyarrow as pa

    texts = ["a" * (i % 7 * 100_000) for i in range(40)] + [None, "x"] * 300
    column = pa.array(["left out", *texts]).slice(1)
    back = [(b, t) for b, t in language_id.slabs(column)]
    assert [x for _, t in back for x in t] == [t or "" for t in texts]
    assert [b for b, _ in back] == list(np.cumsum([0, *(len(t) for _, t in back)])[:-1])


def test_sums_text_by_text_are_those_of_the_product():
    rng = np.random.default_rng(4)
    texts = []
    for _ in range(40):
        text = "".join(rng.choice(list("abcdefgh ÄİΣß\n1"), 200))
        texts += [text[:n] for n in (12, 24, 48, 96)] + [text, text]
    slab = language_id.Slab(["", "1", "a", *texts, "", "x"])
    product = slab.bundle(np.arange(slab.texts), slab.texts, 64, np.float32)
    assert np.array_equal(slab.nested(64), product) and np.array_equal(slab.bundles(64), product)
    none = language_id.Slab(["", "?"])
    assert not none.nested(64).any()


def test_a_document_is_scored_once(spark, monkeypatch):
    scored, predict = [], language_id.predict

    def counted(docs, *args, **kwargs):
        scored.append(docs.where(F.length("text") > 400).count())
        return predict(docs, *args, **kwargs)

    monkeypatch.setattr(language_id, "predict", counted)
    rows = [(i, " ".join(f"{w}{'aeiou'[i % 5]}" for w in ["some", "word", "line", "text"] * 30), "en", "s", 1) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert cp.identify_language(spark, docs, "").count() == 20
    assert sum(scored) == 20
