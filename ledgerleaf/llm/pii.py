"""Personal data by weak supervision: labelers vote, their reliabilities are estimated, a classifier decides.

Candidates are the matches of four strict patterns (email, ip, card, phone), whether or not they pass the checks
of their kind, and of two loose ones (an address spelled with "at" and "dot", a number without its country
code).  Four labelers vote +1, -1 or 0 on each: the rule of the kind, a gazetteer, the words before it, and its shape.
Expectation-maximisation over the counts of vote patterns gives how often each labeler is right and how
likely each pattern is personal data.  A logistic classifier of the span's features is fitted to these likelihoods.
Spans that pass the rule of a strict pattern always stay; the classifier adds others.

Only DataFrame functions touch the rows.  The driver sees the counts of at most
``4 kinds x 81 votes x 5 sizes x 2`` patterns, whatever the input.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerleaf.llm.common import read
from ledgerleaf.plans.storage import materialise

KINDS = ("email", "ip", "card", "phone")
#: Loops that can neither give back nor be entered in the middle, so that long runs cost linear time.
STRICT = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]++(?: at | ?[\[(]at[\])] ?)[a-z0-9-]++(?:(?:\.| dot | ?[\[(]dot[\])] ?)[a-z0-9-]++)++",
    "phone": r"(?<![0-9+(.-])\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9.-])",
}
#: A cheap test that every match of the pattern passes.
MAY_HOLD: dict[str, Callable[[Column], Column]] = {
    "email": lambda t: t.contains("@"), "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9][\x20-]?[0-9]"), "phone": lambda t: t.contains("+"),
}
MAY_HOLD_LOOSE: dict[str, Callable[[Column], Column]] = {
    "email": lambda t: t.rlike(r"(?i)[ \[(]at[ \])]"), "phone": lambda t: t.rlike(r"[0-9]\)?[ .-][0-9]{3,4}[ .-][0-9]"),
}
DOMAINS = "com org net edu gov info io de fr es uk eu ch at it nl"
CARD_PREFIX = "^(?:4|5[1-5]|2[2-7]|3[47]|6)"
CALLING = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
NEAR = {
    "email": "e-?mail|mail|contact|contacto|correo|courriel|write to|schreiben",
    "ip": r"\bip\b|host|server|address|adresse|login from",
    "card": "card|visa|mastercard|credit|debit|tarjeta|carte|karte",
    "phone": r"phone|\btel\b|telefon|call|mobile|fax|movil|portable",
}
NOT_NEAR = r"order|invoice|version|\bid\b|isbn|serial|ticket|\bv$|page|build"
WINDOW = 40
LABELERS = ("rule", "gazetteer", "context", "shape")
SPAN = "struct<start:int,kind_no:int,end:int,base:boolean,rule:int,gazetteer:int,context:int,shape:int,size:int,loose:int>"


#: Matches whose places are summed in one go; a sum copies what it has so far.
CHUNK = 256


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    return F.element_at(F.transform(F.array(value), then), 1)


def _vote(yes: Column, no: Column | None = None) -> Column:
    vote = F.when(yes, F.lit(1))
    return vote.when(no, F.lit(-1)).otherwise(F.lit(0)) if no is not None else vote.otherwise(F.lit(-1))


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _rule(kind: str, match: Column) -> Column:
    """Whether a match of the strict pattern passes the check of its kind."""
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda x: _once(
            F.regexp_replace(x, "^0+", ""), lambda v: (F.length(v) <= 2) | ((F.length(v) == 3) & (v <= "255"))))
    if kind == "card":
        return _once(_digits(match), lambda d: F.when(F.length(d).between(12, 19), F.call_function("luhn_check", d))
                     .otherwise(F.lit(False)))
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    return F.lit(True)


def _gazetteer(kind: str, match: Column) -> Column:
    if kind == "email":
        return _vote(match.rlike("(?i)(?:" + "|".join(DOMAINS.split()) + ")$"))
    if kind == "card":
        return _vote(match.rlike(CARD_PREFIX))
    if kind == "phone":
        return _vote(match.rlike(CALLING), match.startswith("+"))
    return _vote(match.rlike(r"^(?:[1-9]|[1-9][0-9]|1[0-9][0-9]|2[01][0-9]|22[0-3])\."))


def _shape(kind: str, match: Column) -> Column:
    if kind == "email":
        return _vote(match.rlike(r"^[A-Za-z0-9](?:.*[A-Za-z0-9])?(?:@|.at).") & ~match.contains(".."))
    if kind == "card":
        return _vote(F.length(_digits(match)).isin(15, 16) & match.rlike(r"^(?:[0-9]+|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{3,4})$"))
    if kind == "phone":
        return _vote(F.length(_digits(match)).between(9, 13), F.length(_digits(match)) < 7)
    return _vote(~match.rlike(r"(?:^|\.)0[0-9]") & ~match.rlike("[0-9]{4}"))


def _spans(text: Column, kind: str, loose: bool) -> Column:
    """All candidates of one pattern with their votes, in the order of the text."""
    pattern = (LOOSE if loose else STRICT)[kind]
    number = KINDS.index(kind)

    def one(state: Column, i: Column, match: Column, before: Column) -> Column:
        start = state["pos"] + F.length(before)
        rule = F.lit(False) if loose else _rule(kind, match)
        near = F.lower(F.right(before, F.lit(WINDOW)))
        digits = F.length(_digits(match))
        size = F.when(digits < 7, 0).when(digits < 9, 1).when(digits < 12, 2).when(digits < 17, 3).otherwise(4)
        row = F.struct(
            start.alias("start"), F.lit(number).alias("kind_no"), (start + F.length(match)).alias("end"), rule.alias("base"),
            (F.lit(0) if loose else F.when(rule, 1).otherwise(-1)).alias("rule"), _gazetteer(kind, match).alias("gazetteer"),
            _vote(near.rlike(NEAR[kind]), near.rlike(NOT_NEAR)).alias("context"), _shape(kind, match).alias("shape"),
            size.alias("size"), F.lit(int(loose)).alias("loose"))
        return F.struct((start + F.length(match)).alias("pos"), F.concat(state["out"], F.array(row.cast(SPAN))).alias("out"))

    def chunk(z: Column, state: Column, number: Column) -> Column:
        first = number * CHUNK + 1
        spans = F.aggregate(
            F.sequence(first, F.least(first + CHUNK - 1, F.size(z["found"]))), F.struct(state["pos"].alias("pos"), none.alias("out")),
            lambda at, i: one(at, i, F.element_at(z["found"], i), F.element_at(z["between"], i)))
        return _once(spans, lambda x: F.struct(x["pos"].alias("pos"), F.concat(state["out"], F.array(x["out"])).alias("out")))

    def walk(z: Column) -> Column:
        start = F.struct(F.lit(0).alias("pos"), F.array().cast(f"array<array<{SPAN}>>").alias("out"))
        chunks = F.sequence(F.lit(0), F.floor((F.size(z["found"]) - 1) / CHUNK).cast("int"))
        return F.when(F.size(z["found"]) > 0, F.aggregate(
            chunks, start, lambda state, number: chunk(z, state, number), lambda state: F.flatten(state["out"])))

    none = F.array().cast(f"array<{SPAN}>")
    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("between"))
    holds = (MAY_HOLD_LOOSE if loose else MAY_HOLD)[kind](text)
    return F.coalesce(F.when(holds, _once(both, walk)), F.array().cast(f"array<{SPAN}>"))


def _mask(spans: Column) -> Column:
    """A byte for each place up to the end of the last of ``spans`` (in order, apart): x inside those that passed their rule."""
    def piece(span: Column, i: Column) -> Column:
        gap = span["start"] - F.coalesce(F.get(spans, i - 1)["end"], F.lit(0))
        return F.concat(F.repeat(F.lit("."), gap), F.repeat(F.when(span["base"], "x").otherwise("."), span["end"] - span["start"]))

    return F.array_join(F.transform(spans, piece), "").cast("binary")


def candidates(text: Column) -> Column:
    """Candidates of all kinds; one that overlaps a span that passed its rule, but did not pass itself, is left out.

    The work grows with the text and its candidates: positions are summed chunk by chunk, and what overlaps is read
    from a mask of the text for each kind.
    """
    strict = [_spans(text, kind, False).alias(kind) for kind in KINDS]
    loose = F.concat(*(_spans(text, kind, True) for kind in LOOSE)).alias("loose")

    def clear(z: Column) -> Column:
        every = F.concat(*(z[kind] for kind in KINDS), z["loose"])
        masks = F.struct(*(_mask(z[kind]).alias(kind) for kind in KINDS))

        def covered(m: Column, s: Column) -> Column:
            cut = lambda kind: F.substr(m[kind], s["start"] + 1, s["end"] - s["start"])
            return reduce(Column.__or__, (F.contains(cut(kind), F.lit(b"x")) for kind in KINDS))

        return F.when(F.size(every) > 0, _once(masks, lambda m: F.filter(every, lambda s: s["base"] | ~covered(m, s)))).otherwise(every)

    return _once(F.struct(*strict, loose), clear)


# --- models: everything below works on counts of patterns ---------------------------------------------------------

def reliabilities(votes: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[float, np.ndarray, np.ndarray]:
    """Expectation-maximisation for one kind: (prior, p[labeler, class, vote], likelihood of each pattern).

    Starts from the share of + among the votes; classes cannot swap, as the first step ties class 1 to it.
    """
    like = np.clip(((votes > 0).sum(1) + 0.5) / ((votes != 0).sum(1) + 1), 0.05, 0.95)
    for _ in range(rounds):
        weight = np.stack([counts * (1 - like), counts * like])
        prior = (weight[1].sum() + 1) / (counts.sum() + 2)
        table = np.stack([[[weight[y][votes[:, j] == v].sum() + 0.5 for v in (-1, 0, 1)] for y in (0, 1)]
                          for j in range(votes.shape[1])])
        table /= table.sum(2, keepdims=True)
        score = np.log([1 - prior, prior])[:, None] + sum(np.log(table[j][:, votes[:, j] + 1]) for j in range(votes.shape[1]))
        new = 1 / (1 + np.exp(score[0] - score[1]))
        if np.abs(new - like).max() < 1e-9:
            break
        like = new
    return float(prior), table, like


FEATURES = [*(f"kind {k}" for k in KINDS), *(f"{name} {v:+d}" for name in LABELERS for v in (-1, 1)),
            *(f"size {i}" for i in range(5)), "loose"]


def _features(row) -> list[float]:
    get = row.__getitem__
    return [*(float(get("kind_no") == k) for k in range(4)), *(float(get(n) == v) for n in LABELERS for v in (-1, 1)),
            *(float(get("size") == i) for i in range(5)), float(get("loose"))]


def fit_classifier(x: np.ndarray, target: np.ndarray, counts: np.ndarray, penalty: float = 0.1, rounds: int = 50) -> np.ndarray:
    """Logistic weights for soft targets by Newton steps; counts enter by their logarithm, so no pattern drowns the rest."""
    weight, coef = np.log1p(counts), np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-x @ coef))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + penalty * np.eye(x.shape[1]),
                               x.T @ (weight * (p - target)) + penalty * coef)
        coef -= step
        if np.abs(step).max() < 1e-8:
            break
    return coef


def train(found: DataFrame) -> np.ndarray:
    """Weights of the span classifier from all candidates of a table with a column ``__spans``."""
    keys = ["kind_no", *LABELERS, "size", "loose"]
    rows = (found.select(F.explode("__spans").alias("s")).select(*(F.col(f"s.{k}").alias(k) for k in keys))
            .groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).orderBy(*keys).collect())
    if not rows:
        return np.zeros(len(FEATURES))
    votes = np.array([[r[n] for n in LABELERS] for r in rows])
    counts, kind = np.array([r.n for r in rows], float), np.array([r.kind_no for r in rows])
    target = np.zeros(len(rows))
    for k in set(kind.tolist()):
        own = kind == k
        target[own] = reliabilities(votes[own], counts[own])[2]
    return fit_classifier(np.array([_features(r) for r in rows]), target, counts)


def _score(span: Column, coef: np.ndarray) -> Column:
    terms = [F.when(span["kind_no"] == k, F.lit(float(coef[k]))).otherwise(F.lit(0.0)) for k in range(4)]
    at = 4
    for name in LABELERS:
        for v in (-1, 1):
            terms.append(F.when(span[name] == v, F.lit(float(coef[at]))).otherwise(F.lit(0.0)))
            at += 1
    for i in range(5):
        terms.append(F.when(span["size"] == i, F.lit(float(coef[at + i]))).otherwise(F.lit(0.0)))
    return sum(terms, F.lit(0.0)) + span["loose"] * F.lit(float(coef[at + 5]))


def find_pii(docs: DataFrame, *, text_col: str = "text", spans_col: str = "spans", threshold: float = 0.5) -> DataFrame:
    """Columns of ``docs`` but the text, with ``spans_col``: array of (start, kind_no, end, base, votes ...), in order.

    start and end count code points, end is exclusive; kind_no counts in KINDS.  Null and empty texts have no
    spans.  Repeated rows stay repeated; a column named ``spans_col`` is replaced.  An empty table gives an empty table.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    others = [c for c in docs.columns if c not in (text_col, spans_col)]
    found = materialise(docs.select(*others, candidates(text).alias("__spans")))
    coef = train(found)
    cut = float(np.log(threshold / (1 - threshold)))
    kept = F.array_sort(F.filter("__spans", lambda s: s["base"] | (_score(s, coef) >= cut)))
    return found.select(*others, kept.alias(spans_col))


def listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind_no"] + 1), s["start"], s["end"])), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and places of personal data in every document."""
    rows = find_pii(read(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["base"])
    count = lambda k: F.size(F.filter("spans", lambda s: s["base"] & (s["kind_no"] == k))).cast("long")
    return rows.select("doc_id", *(count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)),
                       F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


QUERIES = {"op7_pii": query}
