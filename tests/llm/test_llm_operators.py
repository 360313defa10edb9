"""Each operator against a brute-force version or an exact round trip, on awkward rows."""

import base64
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerleaf.llm import ann, bpe, language_id, line_dedup, mixing, pii, shingle_join, spotsigs, token_files, warc
from ledgerleaf.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, key string, __tag string"
LONG = " ".join(f"w{i % 997} the of" for i in range(12_000))
ALPHABET = ["a", "s", "t", "'", "'s", "'re", "'ll", "'t ", " ", "  ", "\n", "\t", "1", "½", "é", "日本", "!", "...", "<|endoftext|>",
            "the", " of", "Ⅷ", "_", "\x1c", "\x85", "🙂", "aaaaaaa", "́"]


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), 7, "k", "x") for i, t, lang, s in rows], SCHEMA)


def sample_rows():
    rng = random.Random(5)
    words = [f"word{i}" for i in range(300)]
    base = [rng.choice(words) for _ in range(60)]
    rows = [(0, None, "en", "a"), (1, "", None, None), (2, " \n\t", "en", "b"), (3, LONG, "de", "a"), (4, "One two", "en", None),
            (5, "one  TWO", "en", "a"), (6, "...!!", None, "c"), (6, "...!!", None, "c")]
    for i in range(10, 30):
        own = list(base)
        for _ in range(i % 9):
            own[rng.randrange(60)] = rng.choice(words)
        rows.append((i, " ".join(own), "en", "a"))
    rows += [(i, "\n".join(" ".join(rng.choice(words) for _ in range(12)) for _ in range(4)), "fr", "b") for i in range(40, 60)]
    rows += [(i, "short a b c d e f"[: 5 + i - 60], "en", "c") for i in range(60, 70)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return sample_rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return docs_of(spark, rows)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# --- byte-pair encoding -----------------------------------------------------------------------------

def test_encoder_equals_the_library():
    rng = random.Random(3)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40))) for _ in range(3_000)]
    texts += ["a" * 3_000, "ab" * 2_000, "'" * 50, " " * 99 + "x", LONG]
    library = Tokenizer.from_file(bpe.default_vocabulary())
    with open(bpe.default_vocabulary(), "rb") as f:
        content = f.read()
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    for own in (bpe.PairIndexEncoder(content), token_files.LibraryEncoder(content)):
        got = list(own.encode_batch(texts))
        assert [g.tolist() for g in got] == want
        assert [own.decode(g) for g in got] == [library.decode(x, skip_special_tokens=False) for x in want]


def test_long_texts_are_cut_where_words_end(monkeypatch):
    from ledgerleaf.llm import pretokens
    parts = pretokens.pieces(LONG, 100)
    assert len(parts) > 100 and "".join(parts) == LONG
    whole, cut = pretokens.Words(), pretokens.Words()
    whole.index([LONG])
    cut.index(parts)
    assert list(whole.number) == list(cut.number)


def test_round_trip_of_awkward_rows(docs, rows, empty):
    back = bpe.decode(bpe.encode(docs)).select("doc_id", "text", "decoded", "size", "__tag").collect()
    assert len(back) == len(rows) and all((r.text or "") == r.decoded and r.size == 7 and r["__tag"] == "x" for r in back)
    assert bpe.decode(bpe.encode(empty)).count() == 0


def test_token_files(spark, docs, rows, empty, tmp_path):
    path = f"file://{tmp_path}/ids"
    token_files.write_ids(docs, path, shard_docs=10)
    got = token_files.read_ids(spark, path).orderBy("start").collect()
    library = Tokenizer.from_file(bpe.default_vocabulary())
    want = collections.Counter((i, tuple([*library.encode(t or "", add_special_tokens=False).ids, 0])) for i, t, *_ in rows)
    assert collections.Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in got) == want
    assert [r.doc_id for r in got] == sorted(r.doc_id for r in got)
    assert [r.start for r in got] == np.cumsum([0, *(len(r.ids) // 4 for r in got)])[:-1].tolist()
    few = token_files.read_documents(spark, path, [4, 45]).collect()
    assert sorted(r.doc_id for r in few) == [4, 45]
    token_files.write_ids(empty, f"file://{tmp_path}/none")
    assert token_files.read_ids(spark, f"file://{tmp_path}/none").count() == 0


# --- language, nearest neighbours --------------------------------------------------------------------

def test_language_id(spark, sf_dir, docs, empty):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = language_id.held_out(F.col("doc_id"))
    profiles = language_id.learn(table.where(~held))
    found = language_id.predict(table.where(held).withColumn("score", F.lit("mine")), profiles)
    right = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.95
    odd = {r.doc_id: r for r in language_id.predict(docs, profiles).collect()}
    assert all(odd[i].lang_pred == "und" and odd[i].score == 0 for i in (0, 1, 2, 6)) and odd[4].lang_pred in profiles
    assert language_id.learn(empty) == {} and language_id.predict(empty, profiles).count() == 0
    assert {r.lang_pred for r in language_id.predict(docs, {}).collect()} == {"und"}
    assert [zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in table.collect()] == [r[0] for r in table.select(held).collect()]


def test_profiles_do_not_depend_on_partitions(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    a, b = language_id.learn(table), language_id.learn(table.repartition(7))
    assert a.keys() == b.keys() and all((a[k] == b[k]).all() for k in a)


def test_nearest(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3_000, 16))
    x[100:400] = x[100]                                   # a hot vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(9_000, None), (9_001, [0.0] * 16), (9_002, [float("nan")] * 16), (9_003, [1.0, None] * 8), (None, [1.0] * 16), (9_004, [1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    queries = table.where("vec_id % 50 = 0")
    got = collections.defaultdict(list)
    for r in ann.nearest(queries, table, rows_per_part=256).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    hits = total = 0
    for q in range(0, 3_000, 50):
        near = unit @ unit[q]
        near[q] = -9
        best = np.lexsort((np.arange(len(x)), -np.round(near, 12)))[:5]
        assert len(got[q]) == 5 and [s for _, s in got[q]] == sorted((s for _, s in got[q]), reverse=True)
        hits += len({v for v, _ in got[q]} & set(best.tolist()))
        total += 5
        for v, s in got[q]:
            assert s == pytest.approx(near[v], abs=1e-12)
    assert set(got) == set(range(0, 3_000, 50)) and hits / total >= 0.9
    assert [v for v, _ in got[100]] == [101, 102, 103, 104, 105]       # ties go to smaller ids
    few = spark.createDataFrame(rows[:3], table.schema)
    assert ann.nearest(few, few).count() == 6 and ann.nearest(few.limit(0), few.limit(0)).count() == 0


# --- joins --------------------------------------------------------------------------------------------

def union_find(ids, edges):
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(500, 560)]
    want = union_find(range(600), edges)
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {i: got.get(i, i) for i in range(600)} == want


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i: i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_shingle_join(spark, docs, rows, empty):
    sets = {i: shingles(t) for i, t, *_ in rows}
    ids = sorted(sets)
    edges = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = union_find(ids, edges)
    got = shingle_join.link(docs).collect()
    assert sorted(r.id for r in got) == sorted(i for i, *_ in rows)
    assert all(r.n_shingles == len(sets[r.id]) and r.component_id == want[r.id] for r in got)
    assert shingle_join.link(empty).count() == 0
    nothing = shingle_join.link(docs_of(spark, [(None, "a b c d e f", "en", "a"), (1, "a b c d e f", "en", "a")])).collect()
    assert sorted((r.id is None, r.component_id) for r in nothing) == [(False, 1), (True, None)]


@pytest.mark.parametrize("boundary", [0, 4, 12])
def test_every_boundary_links_small_sets_alike(spark, monkeypatch, boundary):
    rng = random.Random(boundary)
    rows = []
    for i in range(250):
        own = [f"v{k}" for k in range(rng.randint(4, 18))]
        for _ in range(rng.randint(0, 2)):
            own[rng.randrange(len(own))] = f"u{rng.randrange(4)}"
        rows.append((i, " ".join(own), "en", "a"))
    sets = {i: shingles(t) for i, t, *_ in rows}
    edges = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    monkeypatch.setattr(shingle_join, "choose_boundary", lambda sizes, length: boundary)
    got = {r.id: r.component_id for r in shingle_join.link(docs_of(spark, rows)).collect()}
    assert got == union_find(sets, edges)


def test_boundary_follows_the_cost():
    assert shingle_join.choose_boundary({5: 100, 6: 100}, 1.0) < shingle_join.choose_boundary({5: 100, 6: 100}, 1e6)


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_line_dedup(spark, empty):
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(60)]
    lines = [" ".join(rng.choice(words) for _ in range(25)) for _ in range(30)]
    rows = [(0, None, "en", "a"), (1, "", "en", "a"), (2, "...\n\n!", "en", "a"), (3, "Same line 12\nsame LINE 7,\nother", "en", "a")]
    for i in range(10, 50):
        own = []
        for _ in range(3):
            line = rng.choice(lines).split()
            if rng.random() < 0.5:
                line[rng.randrange(25)] = rng.choice(words)
            own.append(" ".join(line))
        rows.append((i, "\n".join(own), "en", "a"))
    rows.append((None, lines[0], "en", "a"))
    occurrences = [(i, k, x) for i, t, *_ in rows if i is not None for k, x in enumerate(line_dedup.normal_lines(t or "")) if x]
    first = {}
    for i, k, x in occurrences:
        first.setdefault(x, (i, k))
    forms = list(first)
    sims = line_dedup.simhashes(forms).view(np.uint64)
    edges = [(a, b) for a in range(len(forms)) for b in range(a + 1, len(forms)) if int(np.bitwise_count(sims[a] ^ sims[b])) <= 3
             and edit_distance(forms[a], forms[b]) <= 0.15 * max(len(forms[a]), len(forms[b])) + 1e-9]
    assert edges
    group = union_find(range(len(forms)), edges)
    kept = {}
    for n, x in enumerate(forms):
        kept[group[n]] = min(kept.get(group[n], (10**9, 0)), first[x])
    gone = collections.defaultdict(set)
    for i, k, x in occurrences:
        if kept[group[forms.index(x)]] != (i, k):
            gone[i].add(k)
    out = line_dedup.dedup_lines(docs_of(spark, rows).withColumn("__dropped", F.lit(1)))
    for r in out.collect():
        text = next(t for i, t, *_ in rows if i == r.doc_id)
        assert set(r["__dropped"] or []) == gone.get(r.doc_id, set())
        assert r.text == (None if text is None else "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone.get(r.doc_id, set())))
    assert line_dedup.dedup_lines(empty).count() == 0


@pytest.mark.parametrize("rows", [2, 40, 300])
def test_rows_without_a_near_partner_go(monkeypatch, rows):
    import pyarrow as pa
    rng = np.random.default_rng(rows)
    monkeypatch.setattr(line_dedup, "NEAR_ROWS", 64)
    keys = np.sort(rng.integers(0, 5, rows))
    sims = rng.integers(-2**63, 2**63, 6)[rng.integers(0, 6, rows)] ^ (np.int64(1) << rng.integers(0, 63, rows))
    batch = pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.arange(rows)), pa.array(sims)], ["key", "id", "sim"])
    kept = {i for part in line_dedup._with_partner(iter([batch.slice(0, rows // 3), batch.slice(rows // 3)])) for i in part.column("id").to_pylist()}
    near = lambda i, j: int(np.bitwise_count((sims[i] ^ sims[j]).view(np.uint64))) <= 3
    for i in range(rows):
        own = np.flatnonzero(keys == keys[i])
        assert (i in kept) == (len(own) > 64 or any(i != j and near(i, j) for j in own))


def test_spotsigs(spark, docs, rows, empty):
    text = "The quick brown fox of the dark wood and a lazy dog is in the old green house"
    got = docs_of(spark, [(1, text, "en", "a"), (2, text.upper(), "en", "a"), (3, "zzz", "en", "a"), (4, "", "en", "a")]) \
        .select("doc_id", spotsigs.signatures(F.col("text")).alias("s"))
    by = {r.doc_id: r.s for r in got.collect()}
    assert by[1] == by[2] and zlib.crc32(b"the quick brown fox") in by[1] and zlib.crc32(b"of dark wood a") not in by[1]
    assert by[3] == [zlib.crc32(b"zzz")] and by[4] == []
    sigs = {r.doc_id: set(r.s) for r in docs.select("doc_id", spotsigs.signatures(F.col("text")).alias("s")).collect()}
    members, pairs = spotsigs.near_duplicates(docs, threshold=0.6)
    classes = {r.id: r.class_id for r in members.collect()}
    assert set(classes) == set(sigs) and all((c is None) == (not sigs[i]) for i, c in classes.items())
    reps = sorted({c for c in classes.values() if c is not None})
    like = lambda a, b: len(sigs[a] & sigs[b]) / len(sigs[a] | sigs[b])
    want = {(a, b) for a in reps for b in reps if a < b and like(a, b) >= 0.6}
    assert {(r.a, r.b) for r in pairs.collect()} == want
    nexts = {r.doc_id: r["__next_text"] for r in spotsigs.with_next(docs.where("doc_id != 6"), ["text"], bucket_rows=7).collect()}
    ids = sorted((i for i, *_ in rows if i != 6), reverse=True)
    texts = {i: t for i, t, *_ in rows}
    assert nexts == {i: texts[ids[(k + 1) % len(ids)]] for k, i in enumerate(ids)}
    assert spotsigs.with_next(empty, ["text"]).count() == 0


# --- mixing, personal data, archives -------------------------------------------------------------------

def test_mixing(spark, docs, rows, empty):
    rng = random.Random(4)
    many = rows + [(i, " ".join(["w"] * rng.randint(1, 40)), "en", rng.choice("aab") if i % 7 else None) for i in range(100, 1_500)]
    mixed = mixing.mix(docs_of(spark, many)).collect()
    again = mixing.mix(docs_of(spark, many).repartition(5)).collect()
    key = lambda out: sorted((r.doc_id, r["__copies"]) for r in out)
    assert key(mixed) == key(again) and len(mixed) == len(many) and all(r.size == 7 and r.key == "k" for r in mixed)
    sizes = collections.Counter()
    for _, t, _, s in many:
        sizes[s] += len((t or "").encode().split())
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, open_, rest = {}, set(order), 1.5 * sum(sizes.values())
    while open_:
        level = rest / sum(weight[s] for s in open_)
        over = [s for s in open_ if weight[s] * level > 2 * sizes[s]]
        for s in over or open_.copy():
            target[s] = 2.0 * sizes[s] if over else weight[s] * level
            rest -= target[s] if over else 0
            open_.discard(s)
    taken = collections.Counter()
    for r in mixed:
        assert r["__target"] == pytest.approx(target[r.source]) and r["__source_size"] == sizes[r.source]
        assert r["__copies"] in (0, 1, 2)
        taken[r.source] += r["__copies"] * r["__size"]
    largest = max(len((t or "").split()) for _, t, *_ in many)
    assert all(abs(taken[s] - target[s]) <= max(0.02 * target[s], largest) for s in order)
    assert mixing.mix(empty).count() == 0


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    out = []
    for number, kind in enumerate(pii.KINDS):
        for m in re.finditer(PATTERNS[kind], text):
            digits = re.sub("[^0-9]", "", m.group())
            luhn = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(digits[::-1])) % 10 == 0
            ok = {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m.group().split(".")),
                  "card": 12 <= len(digits) <= 19 and luhn, "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), number, m.end()))
    return sorted(out)


def test_pii(spark, docs, empty):
    rng = random.Random(6)
    parts = ["a@b.c", "x_d@e.fg", "@", ".", "1.2.3.4", "300.1.1.1", "4111 1111 1111 1111", "4111-1111", "+1 (766) 555-7744", "+", " ", "😀",
             "5", "12", "mail me at bob at example dot com", "call 555-123-4567", "é", "-", "007.1.2.3", "\n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(400)]
    texts += ["1" * 20_000, "a" * 20_000, "a.b@" * 300, "+" + "1 " * 5_000, LONG]
    table = docs_of(spark, [(i, t, "en", "a") for i, t in enumerate([*texts, None])])
    got = {r.doc_id: r.spans for r in pii.find_pii(table).collect()}
    for i, t in enumerate([*texts, None]):
        assert [(s.start, s.kind_no, s.end) for s in got[i] if s.base] == base_spans(t or "")
        assert all(0 <= s.start < s.end <= len(t) for s in got[i])
    assert pii.find_pii(empty).count() == 0
    assert not any(r.spans for r in pii.find_pii(docs).collect() if r.doc_id in (0, 1, 2))


def test_reliabilities_recover_labelers():
    rng = np.random.default_rng(1)
    truth = rng.random(20_000) < 0.3
    votes = np.stack([np.where(rng.random(len(truth)) < q, truth, ~truth) * 2 - 1 for q in (0.95, 0.9, 0.8, 0.7)], 1)
    pattern, where, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    prior, table, like = pii.reliabilities(pattern, counts.astype(float))
    assert prior == pytest.approx(0.3, abs=0.03) and table[0][1][2] == pytest.approx(0.95, abs=0.03)
    assert ((like[where.ravel()] > 0.5) == truth).mean() > 0.95


def test_warc(spark, tmp_path):
    rows = [(i, f"http://h/{i}", f"<p>{i % 3}é</p>" if i < 9 else f"<p>WARC/1.1\r\n\r\n{i}</p>") for i in range(20)]
    rows += [(30, None, None), (31, "http://x\r\ny", ""), (32, "u", "z" * 500_000)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, __bytes int")
    path = f"file://{tmp_path}/w"
    warc.write_warc(pages, path, records_per_file=6)
    holder = {}
    for i, _, h in rows:
        holder[h or ""] = max(holder.get(h or "", -1), i)
    back = warc.read_warc(spark, path)
    got = {r.page_id: r for r in back.withColumn("page_id", warc.page_id(F.col("record_id"))).collect()}
    assert set(got) == {i for i, *_ in rows}
    for i, _, h in rows:
        raw = (h or "").encode()
        own = holder[h or ""] == i
        assert got[i].record_type == ("response" if own else "revisit") and got[i].payload_bytes == len(raw)
        assert got[i].payload_digest == base64.b32encode(hashlib.sha1(raw).digest()).decode()
        assert got[i].payload == (raw if own else None)
        assert own or got[i].refers_to == f"<urn:page:{holder[h or '']}>"
    picked = warc.read_warc(spark, path, payload=False).where("record_type = 'revisit' and target_uri like 'http://h/%'")
    assert picked.count() == sum(r.record_type == "revisit" and r.page_id < 20 for r in got.values())
    reader = warc.WarcReader(path, True)
    left = list(reader.pushFilters([warc.EqualTo(("record_type",), "revisit"), warc.EqualTo(("payload",), b"")]))
    assert len(left) == 1 and len(reader.tests) == 1 and len(reader.partitions()) >= 1
    warc.write_warc(pages.limit(0), f"file://{tmp_path}/none")
    assert warc.read_warc(spark, f"file://{tmp_path}/none").count() == 0


def test_edits_within_a_bound():
    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, c in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, d in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
        return row[-1]

    rng = random.Random(3)
    texts = ["", "a", "é\U0001f600b"] + ["".join(rng.choices("abcé ", k=rng.randrange(1, 90))) for _ in range(40)]
    for a in texts:
        for b in [*rng.sample(texts, 8), a[:10] + "xy" + a[12:], "q" + a]:
            d = edits(a, b)
            assert all(line_dedup.within(a, b, k) == (d <= k) for k in (0, d - 1, d, d + 1) if k >= 0)


def test_normal_forms_of_lines():
    text = "One,  TWO_2\n\n 12.5 % É-é\r\n__"
    assert line_dedup.normal_lines(text) == ["one two 0", "", "0 0 é é", ""]
    assert [line_dedup.normal_lines(x)[0] for x in text.split("\n")] == line_dedup.normal_lines(text)


def edited_lines(seed, words_of=((1, 2), (6, 10), (11, 20), (21, 40), (41, 60)), each=25):
    """Lines of each length class, each with a copy that has words replaced and one that has letters replaced."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("etaoinshrdlucmfwyp", weights=range(18, 0, -1), k=rng.randint(3, 9)))
    vocabulary = [word() for _ in range(3_000)]
    out = []
    for low, high in words_of:
        for _ in range(each):
            line = " ".join(rng.choices(vocabulary, k=rng.randint(low, high)))
            most = int(0.15 * len(line))
            letters = list(line)
            for i in rng.sample(range(len(line)), most):
                letters[i] = rng.choice("bgjkqvxz")
            own, left = line.split(), most
            for i in rng.sample(range(len(own)), len(own)):
                new = rng.choice(vocabulary)
                if max(len(new), len(own[i])) <= left:
                    left -= max(len(new), len(own[i]))
                    own[i] = new
            out.append(((low, high), line, " ".join(own), "".join(letters)))
    return out


def test_edited_lines_are_found_at_any_length(spark):
    """Recall of linked pairs against edit similarity alone, by words and kind of edit."""
    cases, found = edited_lines(1), collections.defaultdict(list)
    texts, at = [], {}
    for size, line, *copies in cases:
        for kind, copy in zip(("words", "letters"), copies, strict=True):
            if copy != line and edit_distance(line, copy) <= 0.15 * max(len(line), len(copy)) + 1e-9:
                at[2 * len(at) + 1] = (size, kind)
                texts += [line, copy]
    rows = [(i, t, "en", "a") for i, t in enumerate(texts)]  # a line comes before its copies
    gone = {r.doc_id for r in line_dedup.dedup_lines(docs_of(spark, rows), whole=True).where("size(__dropped) > 0").collect()}
    for i, key in at.items():
        found[key].append(i in gone)
    recall = {k: sum(v) / len(v) for k, v in sorted(found.items())}
    assert all(v >= (0.99 if kind == "words" else 0.75) for (_, kind), v in recall.items()), recall


def test_lines_that_differ_in_numbers_are_kept(spark):
    lines = ["2019", "7", "Total 45", "Total 9120", "Same line 12", "same LINE 7,", "Total 45!", "Invoice of the month of May, number 17", "Invoice of the month of May, number 18"]
    out = line_dedup.dedup_lines(docs_of(spark, [(i, x, "en", "a") for i, x in enumerate(lines)]), whole=True)
    assert sorted(r.doc_id for r in out.where("__dropped is not null").collect()) == [6, 8]  # equal, and similar by the edit test


def test_repeated_queries_get_all_their_neighbours(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 8)).tolist()
    table = spark.createDataFrame(list(enumerate(x)), "vec_id long, embedding array<double>")
    asked = spark.createDataFrame([(0, x[0]), (0, x[0]), (1, x[1]), (1, x[5])], table.schema)
    once = lambda i, v: [r.vec_id for r in ann.nearest(spark.createDataFrame([(i, v)], table.schema), table, recall=1.0).orderBy("rank").collect()]
    got = ann.nearest(asked, table, recall=1.0).collect()
    assert [r.vec_id for r in sorted((r for r in got if r.query_id == 0), key=lambda r: r["rank"])] == once(0, x[0])
    assert sorted(r.vec_id for r in got if r.query_id == 1) == sorted(once(1, x[1]) + once(1, x[5]))


def test_texts_of_equal_crc_are_no_near_duplicates(spark):
    seen, pair = {}, None
    for i in range(400_000):
        x = f"word{i * 7919:x}"
        pair = pair or (seen.get(c := zlib.crc32(x.encode())) and (seen[c], x))
        seen[zlib.crc32(x.encode())] = x
    assert pair
    members, pairs = spotsigs.near_duplicates(docs_of(spark, [(i, x, "en", "a") for i, x in enumerate(pair)]))
    assert {r.id: r.class_id for r in members.collect()} == {0: 0, 1: 1} and pairs.count() == 0
