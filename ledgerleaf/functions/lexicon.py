"""Brand lexicon and label overrides as compiled column chains."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerleaf import fixed_values as fv

# case-insensitive, Unicode-aware classes, and only the line feed ends what "." matches
_FLAGS = "(?idU)"


def _alternatives(pattern: str) -> list[str]:
    """Parts of a pattern between the '|' outside parentheses."""
    parts, depth = [""], 0
    for ch in pattern:
        depth += (ch == "(") - (ch == ")")
        if ch == "|" and depth == 0:
            parts.append("")
        else:
            parts[-1] += ch
    return parts


def combined(patterns) -> str:
    """One pattern for several.  Those with a word border at both ends share the
    borders, so that most positions of a text fail on a single test."""
    bordered, others = [], []
    for part in (x for p in patterns for x in _alternatives(p)):
        inner = part[2:-2] if part.startswith(r"\b") and part.endswith(r"\b") else None
        (others if inner is None else bordered).append(part if inner is None else inner)
    shared = [rf"\b(?:{'|'.join(bordered)})\b"] if bordered else []
    return "|".join([*shared, *others])


def _any_of(text: Column, patterns) -> Column:
    return text.rlike(_FLAGS + combined(patterns))


def matches(text: Column, pattern: str) -> Column:
    return F.coalesce(text, F.lit("")).rlike(_FLAGS + combined([pattern]))


def bucket_hits(text: Column, lexicon: dict | None = None) -> dict[str, Column]:
    """One boolean column per lexicon bucket."""
    text = F.coalesce(text, F.lit(""))
    return {bucket: _any_of(text, pats) for bucket, pats in (lexicon or fv.LEXICON).items()}


def coarse_hits(text: Column, lexicon: dict | None = None, to_coarse: dict | None = None) -> dict[str, Column]:
    """One boolean column per coarse key that some lexicon bucket points to."""
    to_coarse = to_coarse or fv.LEXICON_COARSE
    by_key: dict[str, list[str]] = {}
    for bucket, pats in (lexicon or fv.LEXICON).items():
        by_key.setdefault(to_coarse.get(bucket, fv.DEFAULT_COARSE), []).extend(pats)
    text = F.coalesce(text, F.lit(""))
    return {key: _any_of(text, pats) for key, pats in by_key.items()}


def pattern_hits(text: Column, lexicon: dict | None = None) -> Column:
    """Array of (bucket, pattern) structs for every pattern found in the text."""
    text = F.coalesce(text, F.lit(""))
    found = [
        F.when(text.rlike(_FLAGS + p), F.struct(F.lit(bucket).alias("bucket"), F.lit(p).alias("pattern")))
        for bucket, pats in (lexicon or fv.LEXICON).items() for p in pats
    ]
    return F.array_compact(F.array(*found))


def override_rule(text: Column, rules=None) -> Column:
    """Name of the first rule that fires, else null."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    out = None
    for name, pattern, absent, _ in (fv.OVERRIDE_RULES if rules is None else rules):
        cond = matches(lowered, pattern)
        if absent is not None:
            cond = cond & ~matches(lowered, absent)
        out = F.when(cond, F.lit(name)) if out is None else out.when(cond, F.lit(name))
    return F.lit(None).cast("string") if out is None else out


def apply_override(label: Column, rule: Column, rules=None) -> Column:
    """Label that the fired rule sets, or the label itself."""
    pairs = [x for name, _, _, target in (fv.OVERRIDE_RULES if rules is None else rules)
             for x in (F.lit(name), F.lit(target))]
    if not pairs:
        return label
    return F.coalesce(F.try_element_at(F.create_map(*pairs), rule), label)


def hard_override(label: Column, text: Column, rules=None) -> Column:
    return apply_override(label, override_rule(text, rules), rules)
