"""Examples of conversations longer than a page hold their whole prefix."""

import pytest

from ledgerleaf.llm import chat


@pytest.mark.parametrize("limit", [("PAGE_TURNS", 5), ("PAGE_CHARS", 100)])
def test_prefixes_of_many_pages_are_whole(spark, monkeypatch, limit):
    monkeypatch.setattr(chat, *limit)
    said = {c: [("user" if t % 2 else "assistant", f"turn {t} of ###{c}") for t in range(n)] for c, n in ((1, 24), (2, 3), (None, 12))}
    rows = [(c, t, role, text) for c, turns in said.items() for t, (role, text) in enumerate(turns)]
    formatted, stored = chat.examples(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    found = formatted.collect()
    totals = {r.conv_id: r for r in chat.digests(formatted).collect()}
    stored.drop()
    assert any(r.from_turn > 0 for r in found)
    for c, turns in said.items():
        written = [f"### {a}: {b.replace('###', chat.ESCAPES[1][1])}</turn>" for a, b in turns]
        sizes = sum(len("".join(written[: i + 1])) for i, (a, _) in enumerate(turns) if a == "assistant" or i + 1 == len(turns))
        for i, (role, text) in enumerate(turns):
            mine = sorted((r for r in found if r.conv_id == c and r.turn == i), key=lambda r: r.from_turn)
            assert bool(mine) == (role == "assistant" or i + 1 == len(turns))
            if role == "assistant":
                assert "".join(r.text for r in mine) == "".join(written[: i + 1])
                assert [r.loss_start is not None for r in mine] == [False] * (len(mine) - 1) + [True]
        assert totals[c].formatted_chars == sizes
        assert totals[c].n_turns == len(turns)
        assert totals[c].loss_chars == sum(len(b) for a, b in turns if a == "assistant")
