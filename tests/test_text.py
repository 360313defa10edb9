"""Hand-computed text cases."""

from pyspark.sql import functions as F

from ledgerleaf.functions import lexicon as lx
from ledgerleaf.functions import text as tx


def one(spark, column, value="x", **more):
    df = spark.createDataFrame([(value, *more.values())], ["t", *more] if more else "t string")
    return df.select(column.alias("out")).first()["out"]


def test_normalize(spark):
    norm = lambda s: one(spark, tx.normalize_text(F.col("t")), s)
    assert norm("A-B_C:123 45 x9999") == "b 45 x9999"
    assert norm("REF CARD614755") == "card614755"
    assert norm("") == "" and norm(None) == ""
    assert norm("UPI/REF 12345") == ""
    assert norm("é123") == "123"
    assert norm("Jaipur MUMBAI") == "jaipur"


def test_char_ngrams(spark):
    grams = lambda s: sorted(one(spark, tx.char_ngrams(tx.tokens(F.col("t"), ())), s))
    assert grams("a") == [" a "]
    assert grams("ab") == sorted([" ab", "ab ", " ab "])
    assert grams("ab z") == sorted([" ab", "ab ", " ab ", " z "])
    assert grams("abcd") == sorted([" ab", "abc", "bcd", "cd ", " abc", "abcd", "bcd ", " abcd", "abcd "])
    assert grams("") == []


def test_word_ngrams_skip_single_characters(spark):
    words = tx.word_tokens(tx.tokens(F.col("t"), ()))
    assert one(spark, tx.word_ngrams(words), "ab z cd ef") == ["ab", "cd", "ef", "ab cd", "cd ef"]
    assert one(spark, tx.word_ngrams(words), "z") == []
    assert one(spark, tx.word_ngrams(words, 1, 3), "ab cd ef")[-1] == "ab cd ef"


def test_overrides(spark):
    rule = lambda s: one(spark, lx.hard_override(F.lit("KEEP"), F.col("t")), s)
    assert rule("jio recharge") == "UTILITIES_TELECOM"
    assert rule("ajio order") == "SHOPPING_ECOM"
    assert rule("jio ajio") == "SHOPPING_ECOM"
    assert rule("hpcl zomato") == "FUEL"
    assert rule("MCDONALDS") == "DINING"
    assert rule("lunch") == "KEEP" and rule(None) == "KEEP"
    assert one(spark, lx.hard_override(F.lit("KEEP"), F.col("t"), ()), "jio") == "KEEP"


def test_override_is_idempotent(spark):
    once = lx.hard_override(F.lit("KEEP"), F.col("t"))
    for text in ("jio", "croma jio", "uber", "x"):
        assert one(spark, lx.hard_override(once, F.col("t")), text) == one(spark, once, text)


def test_lexicon_borders(spark):
    hits = lambda s: {b for b, c in lx.bucket_hits(F.col("t")).items() if one(spark, c, s)}
    assert hits("MCDONALDS") == set() and hits("mcd store") == {"FOOD"}
    assert hits("reliance digital") == {"SHOPPING"}
    assert hits("jioé") == set()


def test_shorten_and_parse(spark):
    assert one(spark, tx.shorten(F.col("t"), 5), "abcdef") == "ab..."
    assert one(spark, tx.shorten(F.col("t"), 3), "abcdef") == "abc"
    assert one(spark, tx.shorten(F.col("t"), 6), "abcdef") == "abcdef"
    assert one(spark, tx.parse_explanation(F.col("t")), "a:1; ;b:2;c;d;e;f") == ["a:1", "b:2", "c", "d", "e"]


def test_extract_finds_what_a_line_names(spark):
    df = spark.createDataFrame([("UPI", 7, "@desk"), ("CARD", 123456, "VISA"), ("NEFT", 1, "HDFC"), ("EMI", 42, ""), ("ATM", 9, "")],
                               "channel string, k long, payer string")
    ref = tx.reference_id(F.col("channel"), F.col("k"))
    found = tx.extract_reference(F.col("line"))
    rows = df.withColumn("ref", ref).withColumn("line", F.concat_ws(" ", F.lit("Shop tea"), "payer", "ref", F.lit("Pune"))).select(
        "channel", "ref", *[c.alias(n) for n, c in found.items()]).collect()
    for r in rows:
        assert r["ext_reference"] == r["ref"]
        assert r["ext_channel"] == (r["channel"] if r["channel"] != "ATM" else "OTHER")
    by = {r["channel"]: r for r in rows}
    assert by["UPI"]["ext_handle"] == "@desk" and by["CARD"]["ext_network"] == "VISA" and by["NEFT"]["ext_bank"] == "HDFC"


def test_variants_differ_in_one_place(spark):
    text = F.col("t")
    for i, t in enumerate(["a b c d", "one", "", None, "two words"]):
        swapped = one(spark, tx.swapped_words(text, F.lit(i)), t)
        dropped = one(spark, tx.dropped_letter(text, F.lit(i)), t)
        if not t:
            assert swapped == t and dropped == t
            continue
        words, mixed = t.split(" "), swapped.split(" ")
        assert sorted(words) == sorted(mixed)
        assert [x != y for x, y in zip(words, mixed, strict=True)].count(True) == (2 if len(words) > 1 else 0)
        assert dropped in {t[:k] + t[k + 1:] for k in range(len(t))}
