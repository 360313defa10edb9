"""Patterns as a table against testing every pattern on every text."""

import random
import re

from ledgerleaf.operators import patterns as pt


def test_literal_runs_are_in_every_match():
    want = {r"\bswiggy\b": ["swiggy"], r"mc(d|donald)s": ["mc", "s"], r"colou?r": ["colo", "r"], r"a+bc": ["a", "bc"],
            r"ab{2}cd": ["a", "cd"], r"x[abc]yz\.com": ["x", "yz.com"], r"reliance\s*digital": ["reliance", "digital"],
            r"(foo)?": [], r"a(b(c)d)e": ["a", "e"], r"\x41bc": [], r"(a\)b)cd": ["cd"], "^ab$": ["ab"], ".*": [], "ab*": ["a"]}
    assert {p: pt.literal_runs(p) for p in want} == want


def test_thousands_of_patterns_equal_brute_force(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(900)]
    texts = [(i, " ".join(rng.choice(words) for _ in range(8)).upper() if i % 3 else " ".join(rng.choice(words) for _ in range(30)))
             for i in range(300)] + [(900, None), (901, ""), (902, "STRASSE ſolo"), (5, "abc again")]
    patterns = {rf"\b{w}\b" for w in words} | {w[:3] for w in words} | {rf"{a}\s+{b}" for a, b in zip(words, words[1:], strict=False)}
    patterns |= {rf"{a}|{b}" for a, b in zip(words[::9], words[4::9], strict=False)} | {"a.b", "^h", "solo", "[x-z]q", "", "ab?c{1,2}d"}
    table = [(p, len(p)) for p in sorted(patterns)] + [("solo", -1), (None, 0)]
    got = pt.pattern_join(spark.createDataFrame(texts, "row_id long, text string").repartition(3),
                          spark.createDataFrame(table, "pattern string, weight int")).collect()
    found = {(i, p) for i, t in texts for p in patterns if re.search(p, t or "", re.IGNORECASE)}
    assert len(patterns) > 2_000
    assert sorted((r.row_id, r.pattern, r.weight) for r in got) == sorted((i, p, w) for i, p in found for q, w in table if p == q)
    none = spark.createDataFrame([], "pattern string, weight int")
    assert pt.pattern_join(spark.createDataFrame(texts, "row_id long, text string"), none).count() == 0
