"""Mixing of rows without an id."""

from ledgerleaf.llm import mixing


def test_rows_without_an_id_meet_their_target(spark):
    rows = [(None, " ".join([f"w{i}"] + ["x"] * 9), "a") for i in range(600)] + [(None, "same text", "a")] * 3
    rows += [(i, " ".join(["y"] * 10), "b") for i in range(600)]
    mixed = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    for source in "ab":
        own = [r for r in mixed if r.source == source]
        assert abs(sum(r["__copies"] * r["__size"] for r in own) - own[0]["__target"]) <= 10
    assert len({r["__copies"] for r in mixed if r.text == "same text"}) == 1
