"""What must not grow faster than the tables: work for each term of a row, files of a stream."""

from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from ledgerleaf.operators import features as ft
from ledgerleaf.plans import queries as q


def test_rounding_agrees_with_spark(spark):
    rng = np.random.default_rng(1)
    odd = [0.0, -0.0, 0.0078125, -0.0078125, 1e300, 123456789.1234565, 5e-324, -1e-9, np.nan, np.inf, -np.inf]
    values = np.concatenate([rng.random(5_000), 1 / np.sqrt(np.arange(1, 5_000)), np.arange(1, 4_096) / 4_096, (np.arange(1, 5_000) + 0.5) / 1e6, odd])
    rows = spark.createDataFrame([(i, float(x)) for i, x in enumerate(values)], "i long, v double")
    want = np.array([r.w for r in rows.select("i", F.round("v", 6).alias("w")).orderBy("i").collect()])
    assert np.array_equal(ft.rounded(values, 6), want, equal_nan=True)


def test_weights_come_rounded(spark):
    rows = spark.createDataFrame([(i, f"alpha beta {'gamma ' * (i % 4)}") for i in range(40)] + [(3, "beta delta"), (None, None)], "row_id long, text string")
    tf = ft.term_freq(ft.keyed(rows, "row_id", "text"), q.NB, grouped=True)
    vocab = ft.fit_vocabulary(rows, q.NB)
    plain = ft.tfidf(tf, vocab, q.NB).withColumn("value", F.round("value", 6))
    joined = ft.tfidf(tf, vocab, q.NB, limit=0, digits=6).select(plain.columns)
    for found in (ft.tfidf(tf, vocab, q.NB, digits=6), joined):
        assert sorted(map(tuple, found.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)


def test_stream_reads_as_many_files_as_the_lines_have_parts(spark, monkeypatch):
    class Stop(Exception):
        pass

    written = []
    lines = spark.range(0, 700, 1, 7).select(F.col("id").alias("row_id"), F.lit("t").alias("transaction_id"), F.lit("n").alias("narrative"))
    monkeypatch.setattr(q, "lines", lambda spark, d: lines)
    monkeypatch.setattr(q, "nb_model", lambda spark, d: None)

    def stop(spark, folder, schema):
        written.append(folder)
        raise Stop

    monkeypatch.setattr(q.readers, "read_csv_stream", stop)
    try:
        q._stream_run(spark, "unused")
    except Stop:
        pass
    assert len(list(Path(written[0].removeprefix("file:")).glob("*.csv"))) == 7
