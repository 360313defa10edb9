"""Text columns: normalisation, tokens, n-grams, display helpers.

Only built-in expressions, so the work stays inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerleaf import fixed_values as fv

WORD_PREFIX, CHAR_PREFIX = "w__", "c__"

# A run of three or more digits that touches no other letter or digit.  The
# look-arounds name Unicode classes: "\b" means different things per engine.
_LONE_DIGITS = r"(?<![\p{L}\p{N}])\p{Nd}{3,}(?![\p{L}\p{N}])"


def raw_tokens(text: Column) -> Column:
    """Lower-cased ``[a-z0-9]+`` tokens without stand-alone long digit runs."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    return F.regexp_extract_all(
        F.regexp_replace(lowered, _LONE_DIGITS, " "), F.lit("[a-z0-9]+"), F.lit(0)
    )


def tokens(text: Column, stop=tuple(fv.NOISE_TOKENS + fv.CITY_STOP)) -> Column:
    """``raw_tokens`` minus the stop tokens."""
    if not stop:
        return raw_tokens(text)
    return F.filter(raw_tokens(text), lambda t: ~t.isin(*stop))


def normalize_text(text: Column, stop=tuple(fv.NOISE_TOKENS + fv.CITY_STOP)) -> Column:
    return F.array_join(tokens(text, stop), " ")


def word_tokens(toks: Column) -> Column:
    """Word features need at least two characters."""
    return F.filter(toks, lambda t: F.length(t) >= 2)


def word_ngrams(words: Column, lo: int = 1, hi: int = 2) -> Column:
    """Contiguous word n-grams, ``lo`` to ``hi`` words long."""
    grams = []
    for n in range(lo, hi + 1):
        if n == 1:
            grams.append(words)
            continue
        starts = F.greatest(F.size(words) - F.lit(n - 1), F.lit(0))
        acc = F.slice(words, F.lit(1), starts)
        for shift in range(2, n + 1):
            acc = F.zip_with(
                acc, F.slice(words, F.lit(shift), starts), lambda a, b: F.concat_ws(" ", a, b)
            )
        grams.append(acc)
    return F.concat(*grams)


def char_ngrams(toks: Column, lo: int = 3, hi: int = 5) -> Column:
    """Character n-grams inside each token padded by one blank on both sides.

    Tokens are laid out as ``' a '`` next to ``' b '``; a window that holds two
    adjacent blanks would cross a token border and matches no alternative.
    """
    laid_out = F.concat(F.lit(" "), F.array_join(toks, "  "), F.lit(" "))
    grams = []
    for n in range(lo, hi + 1):
        window = rf"(?=( [^ ]{{{n - 1}}}|[^ ]{{{n}}}|[^ ]{{{n - 1}}} | [^ ]{{{n - 2}}} ))"
        grams.append(F.regexp_extract_all(laid_out, F.lit(window), F.lit(1)))
    return F.concat(*grams)


def prefixed(terms: Column, prefix: str) -> Column:
    return F.transform(terms, lambda t: F.concat(F.lit(prefix), t))


def shorten(text: Column, limit: int = 96) -> Column:
    """Cut to ``limit`` characters, the last three being dots when there is room."""
    cut = F.left(text, F.lit(limit)) if limit <= 3 else F.concat(F.left(text, F.lit(limit - 3)), F.lit("..."))
    return F.when(F.length(text) <= limit, text).otherwise(cut)


def fixed_decimals(value: Column, digits: int, keep: int = 6) -> Column:
    """Text with ``digits`` decimals, rounded on the decimal value."""
    return value.cast(f"decimal(24,{keep})").cast(f"decimal(24,{digits})").cast("string")


def parse_explanation(text: Column, limit: int = 5) -> Column:
    """``'a:1.00; b:0.50'`` -> first ``limit`` non-blank parts."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), ";"), lambda p: F.trim(p))
    return F.slice(F.filter(parts, lambda p: p != ""), 1, limit)


# ---- statement formats ------------------------------------------------------

def _by_channel(channel: Column, per_channel: dict, other: Column) -> Column:
    out = None
    for name, value in per_channel.items():
        out = F.when(channel == name, value) if out is None else out.when(channel == name, value)
    return out.otherwise(other)


def reference_id(channel: Column, key: Column) -> Column:
    """Channel prefix and a zero-padded number of the channel's width."""
    def one(fmt):
        prefix, digits = fmt
        number = F.pmod(key, F.lit(10 ** digits)).cast("string")
        return F.concat(F.lit(prefix), F.lpad(number, digits, "0"))

    return _by_channel(
        channel, {c: one(f) for c, f in fv.REFERENCE_FORMATS.items()}, one(fv.REFERENCE_FORMAT_OTHER)
    )


def extract_reference(text: Column) -> dict[str, Column]:
    """Reference id, channel, payment handle, bank and card network of a line."""
    upper = F.upper(F.coalesce(text, F.lit("")))
    formats = {**fv.REFERENCE_FORMATS, "OTHER": fv.REFERENCE_FORMAT_OTHER}
    ids = "|".join(f"{prefix}[0-9]{{{digits}}}" for prefix, digits in formats.values())
    reference = F.regexp_extract(upper, rf"\b({ids})\b", 1)
    prefix = F.regexp_extract(reference, r"^([A-Z]+)", 1)
    channel = F.lit("")
    for name, (pre, _) in formats.items():
        channel = F.when(prefix == pre, F.lit(name)).otherwise(channel)
    return {
        "ext_reference": reference,
        "ext_channel": channel,
        "ext_handle": F.lower(F.regexp_extract(upper, "(@[A-Z]+)", 1)),
        "ext_bank": F.regexp_extract(upper, rf"\b({'|'.join(fv.BANK_CODES)})\b", 1),
        "ext_network": F.regexp_extract(upper, rf"\b({'|'.join(fv.CARD_NETWORKS)})\b", 1),
    }


# ---- deterministic variants -------------------------------------------------

def draw(key: Column, salt: str) -> Column:
    """Uniform number in [0, 1) taken from the first 32 bits of an md5."""
    head = F.substring(F.md5(F.concat(key.cast("string"), F.lit(f":{salt}"))), 1, 8)
    return F.conv(head, 16, 10).cast("double") / F.lit(float(2 ** 32))


def place(key: Column, salt: str, n: Column) -> Column:
    """One of the places 1 to n, drawn from the key."""
    return (F.floor(draw(key, salt) * n) + 1).cast("int")


def swapped_words(text: Column, key: Column) -> Column:
    """Two neighbouring words change places; a text of one word stays."""
    words = F.split(text, " ")
    n = F.size(words)
    at = place(key, "words", n - 1)
    mixed = F.concat(F.slice(words, F.lit(1), at - 1), F.array(F.get(words, at), F.get(words, at - 1)),
                     F.slice(words, at + 2, F.greatest(n - at - 1, F.lit(0))))
    return F.when(n > 1, F.array_join(mixed, " ")).otherwise(text)


def dropped_letter(text: Column, key: Column) -> Column:
    """One character goes; the empty text stays."""
    at = place(key, "letter", F.length(text))
    return F.concat(F.substring(text, F.lit(1), at - 1), F.substring(text, at + 1, F.length(text)))
