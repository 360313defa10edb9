"""Personal data in texts that hold very many matches."""

import time

from pyspark.sql import functions as F

from ledgerleaf.llm import pii


def test_candidates_over_spans_that_passed_are_left_out(spark):
    text = "a@b.co, 10.0.0.1 and 999.1.2.3; card 4111 1111 1111 1111 or +4111 1111 1111 1111 x. bob at foo dot com, é🙂 020 7946 0958"
    spans = spark.range(1).select(pii.candidates(F.lit(text)).alias("s")).first().s
    base = [s for s in spans if s.base]
    assert [(pii.KINDS[s.kind_no], text[s.start: s.end]) for s in base] == [
        ("email", "a@b.co"), ("ip", "10.0.0.1"), ("card", "4111 1111 1111 1111"), ("card", "4111 1111 1111 1111")]
    for s in spans:
        assert s.base or not any(b.start < s.end and s.start < b.end for b in base)
    assert ("email", "bob at foo dot com") in {(pii.KINDS[s.kind_no], text[s.start: s.end]) for s in spans if s.loose}
    assert ("phone", "020 7946 0958") in {(pii.KINDS[s.kind_no], text[s.start: s.end]) for s in spans if s.loose}


def test_a_megabyte_of_addresses(spark):
    n = 70_000
    words = "".join(f"u{i}@x.org " for i in range(n))
    assert len(words) > 850_000
    table = spark.createDataFrame([(1, words), (2, "one a@b.org")], "doc_id long, text string")
    start = time.perf_counter()
    got = {r.doc_id: r for r in pii.find_pii(table).select(
        "doc_id", F.size("spans").alias("n"), F.element_at("spans", -1).alias("last")).collect()}
    assert time.perf_counter() - start < 60
    assert got[1].n == n and words[got[1].last.start: got[1].last.end] == f"u{n - 1}@x.org" and got[2].n == 1
