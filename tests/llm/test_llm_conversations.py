"""Chat examples, the Merkle manifest and the prefix trie against plain versions and SQL, on awkward rows."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from compare import connect, differences, plain
from ledgerleaf.llm import chat, merkle, trie
from ledgerleaf.llm.positions import numbered
from ledgerleaf.llm.registry import llm_oracles, llm_queries

TURNS = "conv_id long, turn long, role string, text string, size int, __part string, idx string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def turns_of(spark, rows):
    return spark.createDataFrame([(*r, 1, "p", "i") for r in rows], TURNS).repartition(5)


def awkward_turns():
    rng = random.Random(3)
    odd = ["", "\\", "\\e", "\\\\h", "###", "####", "</turn>", "</tur", "n>", "### user: x</turn>", "\n", "é🙂", ": ", "word two  three"]
    rows = [(0, None, None, None), (0, None, "user", "x"), (0, 3, "assistant", "y"), (1, 0, "assistant", ""), (2, 0, "ro: le", "a"),
            (3, 0, "user", "same"), (3, 0, "user", "same"), (3, 0, "assistant", "same"), (4, 5, "assistant", "long " * 40_000)]
    for c in range(5, 60):
        rows += [(c, t, rng.choice(["user", "assistant", "system"]), rng.choice(odd) + rng.choice(odd)) for t in range(rng.randrange(1, 7))]
    rows += [(60, t, rng.choice(["user", "assistant"]), f"turn {t} of many") for t in range(700)]  # most of all rows
    return rows


def in_order(rows):
    """Turns by conversation; equal turns have equal or hash-ordered texts, so ties are left out of what is compared."""
    convs = {}
    for c, t, role, text, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0)):
        convs.setdefault(c, []).append((role or "", text or ""))
    return convs


@pytest.fixture(params=["coalesced", "many parts"])
def parts(spark, request):
    """The second way spreads even small tables, so that a key lies in several parts."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", str(request.param == "coalesced").lower())
    yield request.param
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


# --- places ------------------------------------------------------------------------------------------


def test_places_are_those_of_a_sort(spark, parts):
    rows = [(k, v) for k in (None, "a", "b") for v in range({"a": 900, "b": 1}.get(k, 40))]
    df = spark.createDataFrame(rows, "k string, v long").repartition(7)
    placed, stored = numbered(df, "k", ["v"], "test", size="v")
    got = {(r.k, r.v): (r.idx, r.start) for r in placed.collect()}
    assert (stored.df.where("k = 'a'").select("__part").distinct().count() > 2) == (parts == "many parts")
    stored.drop()
    assert got == {(k, v): (v, v * (v - 1) // 2) for k, v in rows}


# --- chat examples ------------------------------------------------------------------------------------


@pytest.mark.parametrize("limits", [{}, {"page_chars": 300, "page_turns": 5}])
def test_examples_are_prefixes(spark, limits):
    rows = [r for r in awkward_turns() if r[0] not in (0, 3)]  # without ties
    formatted, stored = chat.examples(turns_of(spark, rows), **limits)
    found = formatted.collect()
    stored.drop()
    by_page = {}
    for r in found:
        by_page.setdefault(r.conv_id, {}).setdefault(r.from_turn, []).append(r)

    def unescape(text, pairs=chat.ESCAPES):
        for plain_, code in reversed(pairs):
            text = text.replace(code, plain_)
        return text

    def turns(text):
        parts = text.split(chat.CLOSE)
        assert parts.pop() == ""
        both = [p.removeprefix(chat.OPEN).split(chat.BETWEEN, 1) for p in parts]
        return [(unescape(a, chat.ROLE_ESCAPES), unescape(b)) for a, b in both]

    for conv, said in in_order(rows).items():
        pages = [by_page[conv][k] for k in sorted(by_page[conv])]
        if not limits:
            assert len(pages) == 1
        back, targets = [], []
        for page in pages:
            page.sort(key=lambda r: r.turn)
            assert [r.whole for r in page] == [False] * (len(page) - 1) + [True]
            for r in page:
                own = turns(r.text)
                assert own == said[r.from_turn: r.turn + 1]
                if r.loss_start is not None:
                    assert said[r.turn][0] == "assistant"
                    assert unescape(r.text[r.loss_start: r.loss_end]) == said[r.turn][1]
                    targets.append(r.turn)
            back += turns(page[-1].text)
        assert back == said
        assert targets == [i for i, (role, _) in enumerate(said) if role == "assistant"]


def test_digests_read_the_turns_back(spark, parts):
    rows = awkward_turns()
    for limits in ({}, {"page_chars": 300, "page_turns": 5}):
        formatted, stored = chat.examples(turns_of(spark, rows), **limits)
        got = {r.conv_id: r for r in chat.digests(formatted).collect()}
        stored.drop()
        assert got.keys() == in_order(rows).keys()
        for conv, said in in_order(rows).items():
            assert got[conv].n_turns == len(said)
            if conv not in (0, 3):  # without ties
                assert got[conv].turns_sha256 == sha("".join(f"{a}\n{b}\n" for a, b in said))
                replies = "".join(b for a, b in said if a == "assistant")
                assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(replies), sha(replies))


def test_rows_without_id_and_empty_tables(spark):
    rows = [(None, 0, "user", "a"), (None, 1, "assistant", "b")]
    formatted, _ = chat.examples(turns_of(spark, rows))
    assert [(r.conv_id, r.turn, r.whole) for r in formatted.collect()] == [(None, 1, True)]
    empty = spark.createDataFrame([], TURNS)
    assert chat.digests(chat.examples(empty)[0]).count() == 0
    for rows in ([], [(None, 0, "user", "a")]):
        turns, _ = trie.tokens(turns_of(spark, rows) if rows else empty)
        assert trie.report(*trie.trie(*trie.shared(turns))[:2]).count() == 0


# --- Merkle manifest ----------------------------------------------------------------------------------


def plain_manifest(leaves, arity=2):
    """(group, id, leaf) -> (siblings, subroot, root) by lists."""
    def climb(nodes):
        paths, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            runs = [nodes[i: i + arity] for i in range(0, len(nodes), arity)]
            for path, i in zip(paths, at, strict=True):
                run, place = runs[i // arity], i % arity
                path.append((run[:place], run[place + 1:]))
            at = [i // arity for i in at]
            nodes = [sha("".join(run)) for run in runs]
        return paths, nodes[0]

    groups = {}
    for group, i, leaf in sorted(leaves, key=lambda x: (x[0] is not None, (x[0] or "").encode(), x[1] is not None, x[1] or 0, x[2])):
        groups.setdefault(group, []).append((i, leaf))
    trees = {g: climb([leaf for _, leaf in own]) for g, own in groups.items()}
    high, root = climb([top for _, top in trees.values()])
    out = []
    for (g, own), up in zip(groups.items(), high, strict=True):
        out += [(g, i, leaf, path + up, trees[g][1], root) for (i, leaf), path in zip(own, trees[g][0], strict=True)]
    return out


@pytest.mark.parametrize(("levels", "sizes"), [(10, {"en": 37, None: 1, "": 2, "é": 64, "z": 65}), (2, {"en": 300, None: 3, "de": 4, "fr": 5, "a": 16, "b": 17}),
                                               (1, {"x": 9}), (3, {"only": 1})])
def test_manifest_equals_lists(spark, levels, sizes):
    rows = [(g, None if k == 5 else k // 2, sha(f"{g} {k}")) for g, n in sizes.items() for k in range(n)]  # ids that repeat, one null
    if "en" in sizes:
        rows += [("en", 1, sha("twin"))] * 2
    df = spark.createDataFrame([(*r, "t", 1) for r in rows], "group string, id long, leaf string, text string, other int").repartition(6)
    got, _ = merkle.manifest(df, levels)
    folded = merkle.fold(F.col("leaf"), F.col("path"))
    wrong = merkle.fold(F.lit(sha("another")), F.col("path"))
    got = got.select("id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof"), folded.alias("folded"), wrong.alias("wrong")).collect()
    want = sorted((leaf, sub, root, sha("".join("".join(a + b) for a, b in path))) for _, _, leaf, path, sub, root in plain_manifest(rows))
    assert sorted((r.leaf, r.subroot, r.root, r.proof) for r in got) == want
    assert all(r.folded == r.root and r.wrong != r.root for r in got)


def test_leaf_digests_and_empty_manifest(spark):
    rows = spark.createDataFrame([(1, None, "a-:", 2, "é\n"), (None, "", None, None, None)], "doc_id long, source string, lang string, n_chars long, text string")
    got = [r.d for r in rows.select(merkle.leaf_digest([F.col(c) for c in merkle.FIELDS]).alias("d")).collect()]
    assert got == [sha("1:1-3:a-:1:23:é\n"), sha("-0:---")]
    empty = spark.createDataFrame([], "group string, id long, leaf string")
    assert merkle.manifest(empty)[0].count() == 0


# --- prefix trie ----------------------------------------------------------------------------------------


def plain_trie(convs):
    words = lambda text: len(re.findall(r"[^\x20\x09-\x0D]+", text))
    rebuilt = {}
    for c in convs:
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = convs.get(c - c % 20, [])[:h] + convs[c][h:]
    members, ends = {}, {}
    for c, said in rebuilt.items():
        ends.setdefault(tuple(said), []).append(c)
        for d in range(len(said) + 1):
            members.setdefault(tuple(said[:d]), []).append(c)
    kids, leaves, saved = {}, {}, {}
    for path in members:
        if path:
            kids[path[:-1]] = kids.get(path[:-1], 0) + 1
    for path, own in members.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] = leaves.get(path[:d], 0) + (path not in kids)
            saved[path[:d]] = saved.get(path[:d], 0) + ((len(own) - 1) * words(path[-1][1]) if path else 0)
    return sorted((min(own), len(p), min(members[p[:-1]]) if p else -1, len(own), kids.get(p, 0), leaves[p], saved[p],
                   sha(",".join(map(str, sorted(ends.get(p, [])))))) for p, own in members.items())


def test_trie_equals_brute_force(spark, parts):
    rng = random.Random(8)
    rows = [(c, t, rng.choice(["user", "assistant"]), rng.choice(["", "a", "a b", None])) for c in range(0, 240)
            for t in range(rng.choice([1, 2, 2, 3, 5, 8, 9]))]
    rows += [(c, t, "user", f"copy {t}") for c in range(1000, 1200) for t in range(5)]  # a large group of copies
    rows += [(c, t, "user", f"copy {t % 3}") for c in (2000, 2001) for t in range(130)]  # long ones
    rows += [(7021, 0, "user", "base is absent"), (8000, None, None, None), (8000, 0, "user", "x"), (None, 0, "user", "no id")]
    df = turns_of(spark, rows)
    turns, _ = trie.tokens(df)
    nodes, ends, _ = trie.trie(*trie.shared(turns))
    got = sorted(tuple(-1 if x is None else x for x in r) for r in trie.report(nodes, ends).collect())
    assert got == plain_trie(in_order([r for r in rows if r[0] is not None]))


# --- registered queries ------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["op11_chat_examples", "op12_merkle_manifest", "op13_prefix_trie"])
def test_queries_equal_their_sql(spark, sf_dir, name):
    assert differences(llm_queries()[name](spark, sf_dir), connect(sf_dir), llm_oracles()[name]) == []


def test_tampered_rows_fail(spark, sf_dir):
    rows = llm_queries()["op12_merkle_manifest"](spark, sf_dir).collect()
    chars = {r.doc_id: r.n_chars for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "n_chars").collect()}
    for r in rows:
        changed = zlib.crc32(str(r.doc_id).encode()) % 7 == 0 and plain(chars[r.doc_id]) is not None
        assert r.verified == (not changed)
