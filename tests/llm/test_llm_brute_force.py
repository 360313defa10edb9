"""Operators whose columns or memory the other tests leave out, against plain versions."""

import gzip
import hashlib
import random
import subprocess
import sys

import numpy as np
import pytest
import regex
import xxhash

from ledgerleaf.llm import common, language_id, spotsigs, warc

STOPS = {w for words in spotsigs.ANCHORS.values() for w in words.split()}


def plain_signatures(text):
    """Chains word by word; the last word counts as content when nothing follows it."""
    low = text.lower()
    words = [(m.group(), m.end() == len(low)) for m in regex.finditer(r"[\p{L}\p{N}]+", low)]
    found = set()
    for i, (anchor, _) in enumerate(words):
        if anchor in STOPS:
            chain = [w for w, last in words[i + 1:] if w not in STOPS or last][: spotsigs.CHAIN]
            if len(chain) == spotsigs.CHAIN:
                found.add(" ".join([anchor, *chain]))
    if words and not found:
        found = {low}
    return {xxhash.xxh64_intdigest(x.encode(), seed=42) for x in found}


def plain_likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_spotsigs_query_equals_plain_version(spark, tmp_path):
    rng = random.Random(4)
    words = [*sorted(STOPS)[:12], *(f"word{i}" for i in range(40)), "Été", "ünder", "x1"]
    texts = [None, "", "...", "the", "one", "The Quick, brown fox of", "the a b1 c1 d1 the", "the a b1 c1 d1 the."]
    texts += ["".join(rng.choice(words) + rng.choice([" ", ", ", "\n", " - "]) for _ in range(rng.randrange(1, 60))) for _ in range(60)]
    texts += texts[10:14]
    spark.createDataFrame([(3 * i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, sigs int") \
        .repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in spotsigs.query(spark, str(tmp_path)).collect()}
    texts = [t or "" for t in texts]
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        row, follows = got[3 * i], texts[i - 1]
        swap = len(text) // 3
        edited = text[: len(text) - swap] + follows[:swap]
        own, changed, other = map(plain_signatures, (text, edited, follows))
        assert row.n_chars == len(text) and row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert {int(x, 16) for x in row.fingerprint.split(",") if x} == own
        assert {int(x, 16) for x in row.edited_fingerprint.split(",") if x} == changed
        assert row.near_edited == pytest.approx(plain_likeness(own, changed), abs=1e-12)
        assert row.near_next == pytest.approx(plain_likeness(own, other), abs=1e-12)


def plain_bundle(text, dimensions):
    """Every trigram bound from rolled letter vectors, one by one."""
    line = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
    line = regex.sub(" +", " ", line)
    out = np.zeros(dimensions)
    for i in range(len(line) - 2):
        bound = np.ones(dimensions)
        for k, c in enumerate(line[i: i + 3]):
            bound *= np.roll(language_id.letter_vector(ord(c), dimensions), 2 - k)
        out += bound
    return out


@pytest.mark.parametrize("cells", [4_000_000, 1])
def test_profiles_and_cosines_equal_plain_version(spark, monkeypatch, cells):
    monkeypatch.setattr(language_id, "CELLS", cells)
    monkeypatch.setattr(language_id, "BLOCK", 64)
    texts = [("en", "The cat sat on 3 mats."), ("en", "a  dog; a log"), ("de", "Über den Wolken"), ("de", "und"), ("zz", "語言 文字")]
    want = {}
    for lang, text in texts:
        want[lang] = want.get(lang, 0) + plain_bundle(text, 256)
    slab = language_id.Slab([t for _, t in texts])
    group = np.array([0, 0, 1, 1, 2])
    got = slab.bundle(group, 3, 256, np.float64)
    assert all((row == want[lang]).all() for row, lang in zip(got, ("en", "de", "zz"), strict=True))
    profiles = language_id.learn(spark.createDataFrame(texts, "lang string, text string"), dimensions=256)
    assert all((profiles[k] == want[k]).all() for k in want)
    found = language_id.predict(spark.createDataFrame([("the dog",), ("den Mond",)], "text string"), profiles).collect()
    for row in found:
        v = plain_bundle(row.text, 256)
        cosines = {k: p @ v / np.linalg.norm(p) / np.linalg.norm(v) for k, p in want.items()}
        assert row.lang_pred == max(cosines, key=cosines.get) and row.score == pytest.approx(max(cosines.values()), abs=1e-6)


def test_texts_of_many_letters_stay_in_bounded_memory():
    """256 texts of 3,900 different characters in a process of its own; it held 2.7 GB with dense counts."""
    code = """if True:
        import random, resource, numpy as np
        from ledgerleaf.llm.language_id import Slab
        rng = random.Random(1)
        texts = ["".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(3_900)) for _ in range(256)]
        Slab(["warm up"]).bundle(np.arange(1), 1, 1024, np.float32)
        before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
        Slab(texts).bundle(np.arange(256), 256, 1024, np.float32)
        print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before)
    """
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True)
    assert int(out.stdout) < 500_000  # kilobytes


def test_payload_size_is_pushed_down(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    rows = [(i, f"http://h/{i}", "x" * (i % 7)) for i in range(40)]
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string"), path, min_bytes=3)
    for payload in (True, False):
        found = warc.read_warc(spark, path, payload=payload).where("payload_bytes > 4 and payload_bytes <= 6")
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert " Filter " not in plan.replace("(", " ")
        assert sorted(r.payload_bytes for r in found.collect()) == sorted(i % 7 for i in range(40) if 4 < i % 7)
    responses = warc.read_warc(spark, path).where("record_type = 'response' and payload_bytes = 5")
    assert [len(r.payload) for r in responses.collect()] == [5]


@pytest.mark.parametrize("zipped", [False, True])
def test_broken_records_are_errors(spark, tmp_path, zipped):
    head = b"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:a>\r\nContent-Length: 10\r\n\r\n"
    pack = gzip.compress if zipped else bytes
    name = f"a.warc{'.gz' * zipped}"
    for case, content in {"whole": head + b"0123456789\r\n\r\n", "short": head + b"01234", "nameless": head.replace(b"Content-Length: 10\r\n", b"")}.items():
        (tmp_path / case).mkdir()
        (tmp_path / case / name).write_bytes(pack(content))
    assert [r.payload for r in warc.read_warc(spark, f"file://{tmp_path}/whole").collect()] == [b"0123456789"]
    for payload in (True, False):
        with pytest.raises(Exception, match="ends within"):
            warc.read_warc(spark, f"file://{tmp_path}/short", payload=payload).collect()
    with pytest.raises(Exception, match="ends within"):
        warc.read_warc(spark, f"file://{tmp_path}/short").where("record_type = 'response'").collect()
    with pytest.raises(Exception, match="without Content-Length"):
        warc.read_warc(spark, f"file://{tmp_path}/nameless").collect()


def test_schemes_of_spark_are_mapped():
    assert common.arrow_uri("s3a://bucket/a b") == "s3://bucket/a b" and common.arrow_uri("s3n://b/c") == "s3://b/c"
    assert common.arrow_uri("file:///tmp/x") == "file:///tmp/x" and common.arrow_uri("/tmp/x") == "/tmp/x"
    store, folder = common.file_system("file:///tmp")
    assert folder == "/tmp" and store.get_file_info(folder).is_file is False
