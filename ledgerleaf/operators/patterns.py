"""Pattern matching with the patterns as a table: an equi-join on required fragments before any regular expression runs.

Every alternative of a pattern has literal runs that each of its matches holds.  The rarest fragment of ``SIZE``
characters of these runs, by how many texts hold it, is the key of the alternative.  A text meets a pattern only
under a fragment that both hold, and only such pairs are tested.

Up to a checked number of patterns, a task holds their fragments and looks up those of its texts, without a shuffle;
beyond it the fragments of texts and patterns are joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerleaf.functions.lexicon import _FLAGS, _alternatives
from ledgerleaf.operators import grams as gm
from ledgerleaf.operators.joins import BROADCAST_ROWS, few, join_skewed
from ledgerleaf.plans.storage import materialise

SIZE = 3
#: Up to so many patterns are expressions of their own, compiled once; others are compiled for the pairs they are tested in.
OWN_TESTS = 400


def literal_runs(alternative: str) -> list[str]:
    """Runs of letters, digits and other plain characters that every match of a pattern without top-level '|' holds.

    What stands in parentheses, brackets or before a quantifier that allows none is left out, so a run is never claimed
    wrongly; inline flags and look-arounds are parentheses too.
    """
    runs, run, i = [], "", 0

    def close() -> None:
        nonlocal run
        runs.append(run)
        run = ""

    while i < len(alternative):
        ch = alternative[i]
        if ch in "([":
            close()
            shut, depth, j = {"(": ")", "[": "]"}[ch], 1, i + 1
            while j < len(alternative) and depth:
                if alternative[j] == "\\":
                    j += 1
                elif alternative[j] == ch:
                    depth += 1
                elif alternative[j] == shut:
                    depth -= 1
                j += 1
            i = j
        elif ch == "\\":
            nxt = alternative[i + 1: i + 2]
            if nxt.isalnum():       # a class, a border or a code: no plain character, and what follows a code is unclear
                close()
                if nxt not in "bBdDsSwWAzZ":
                    return []
            else:
                run += nxt
            i += 2
        elif ch in "?*{":           # the character before may be missing or repeated
            run = run[:-1]
            close()
            i = alternative.find("}", i) + 1 if ch == "{" and "}" in alternative[i:] else i + 1
        elif ch in "+.^$":
            close()
            i += 1
        else:
            run += ch
            i += 1
    close()
    return [r for r in runs if r]


def folded(text: Column) -> Column:
    """Texts that differ in case alone become equal, as for a match without regard to case.

    The blank at the end keeps the optimizer from dropping the upper case, which unites letters that share one.
    """
    return F.lower(F.concat(F.upper(F.coalesce(text, F.lit(""))), F.lit(" ")))


def _fragments(value: Column) -> Column:
    whole = F.sequence(F.lit(1), F.length(value) - (SIZE - 1))
    return F.when(F.length(value) >= SIZE, F.array_distinct(F.transform(whole, lambda i: F.substr(value, i, F.lit(SIZE))))) \
        .otherwise(F.array().cast("array<string>"))


def _fragments_of_patterns(patterns: DataFrame) -> DataFrame:
    """(pattern, alternative, fragment): candidates for the key; a null fragment where an alternative has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for pattern in batch.column("pattern").to_pylist():
                for k, part in enumerate(_alternatives(pattern)):
                    low = [r.upper().lower() for r in literal_runs(part)]
                    found = sorted({r[i: i + SIZE] for r in low for i in range(len(r) - SIZE + 1)})
                    rows += [(pattern, k, x) for x in found or [None]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                zip(*rows, strict=True) if rows else ([], [], []), (pa.string(), pa.int32(), pa.string()), strict=True)],
                ["pattern", "alternative", "fragment"])

    return patterns.mapInArrow(run, "pattern string, alternative int, fragment string")


class Held:
    """Fragments as numbers of 63 bits; which of them texts hold."""

    def __init__(self, fragments: list[str]):
        codes = np.frombuffer("".join(fragments).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, SIZE)
        codes = self._codes(codes[:, 0], codes[:, 1], codes[:, 2])
        self.order = np.argsort(codes)
        self.codes = codes[self.order]
        # most windows are ruled out by a few bits of their number
        self.seen = np.zeros(1 << 20, bool)
        self.seen[self._few_bits(codes)] = True

    @staticmethod
    def _codes(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        return a.astype(np.uint64) << np.uint64(42) | b.astype(np.uint64) << np.uint64(21) | c

    @staticmethod
    def _few_bits(codes: np.ndarray) -> np.ndarray:
        return (codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)

    def of(self, folded: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(row, number of the fragment) of each fragment of each text, once."""
        texts = folded.to_pylist()
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        if len(points) < SIZE or not len(self.codes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        row = np.repeat(np.arange(len(texts)), sizes)
        codes = self._codes(points[:-2], points[1:-1], points[2:])
        at = np.flatnonzero(self.seen[self._few_bits(codes)] & (row[:-2] == row[2:]))
        place = np.minimum(np.searchsorted(self.codes, codes[at]), len(self.codes) - 1)
        same = self.codes[place] == codes[at]
        key = np.unique(row[at[same]] * len(self.codes) + self.order[place[same]])
        return key // len(self.codes), key % len(self.codes)


def _counts(rows: DataFrame, fragments: list[str]) -> DataFrame:
    """(fragment, n): how many texts hold each of the fragments; those that none holds are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = Held(fragments), np.zeros(len(fragments), np.int64)
        for batch in batches:
            for _, part in gm.chunks(batch.column("folded")):
                total += np.bincount(held.of(part)[1], minlength=len(fragments))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([fragments[i] for i in some.tolist()], pa.string()), pa.array(total[some])], ["fragment", "n"])

    parts = rows.select(folded(F.col("__text")).alias("folded")).mapInArrow(run, "fragment string, n long")
    return parts.groupBy("fragment").agg(F.sum("n").alias("n"))


def _candidates(rows: DataFrame, keys: list[tuple[str, str]]) -> DataFrame:
    """(__id, __text, __pattern) of every text and pattern that share a key, once; ``keys`` are (number of the pattern, fragment)."""
    fragments = sorted({f for _, f in keys})
    number = {f: i for i, f in enumerate(fragments)}
    pairs = np.array(sorted((number[f], p) for p, f in keys), np.int64).reshape(-1, 2)
    first = np.searchsorted(pairs[:, 0], np.arange(len(fragments) + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Held(fragments)
        for batch in batches:
            for begin, part in gm.chunks(batch.column("folded")):
                row, at = held.of(part)
                n = first[at + 1] - first[at]
                inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                met = np.unique(np.repeat(row, n) << 32 | pairs[np.repeat(first[at], n) + inside, 1])
                whole = pa.array(begin + (met >> 32))
                yield pa.RecordBatch.from_arrays([batch.column("__id").take(whole), batch.column("__text").take(whole),
                                                  pa.array((met & 0xFFFFFFFF).astype(np.int32))], ["__id", "__text", "__pattern"])

    laid = rows.select("__id", "__text", folded(F.col("__text")).alias("folded"))
    return laid.mapInArrow(run, T.StructType([rows.schema["__id"], rows.schema["__text"], T.StructField("__pattern", T.IntegerType())]))


def _tested(rows: DataFrame, closed: DataFrame) -> DataFrame:
    """(__id, pattern) of the patterns found in texts, of those with keys; all keys are on the driver."""
    keys = [(r.pattern, r.fragment) for r in closed.collect()]
    names = sorted({p for p, _ in keys})
    number = {p: i for i, p in enumerate(names)}
    met = _candidates(rows, [(number[p], f) for p, f in keys])
    if len(names) <= OWN_TESTS:
        name, right = F.element_at(F.array(*map(F.lit, names)), F.col("__pattern") + 1), F.lit(False)
        for i, p in reversed(list(enumerate(names))):
            right = F.when(F.col("__pattern") == i, F.col("__text").rlike(_FLAGS + p)).otherwise(right)
        return met.where(right).select("__id", name.alias("pattern"))
    table = rows.sparkSession.createDataFrame(list(enumerate(names)), "__pattern int, pattern string")
    return met.join(F.broadcast(table), "__pattern").where(F.regexp_like("__text", F.concat(F.lit(_FLAGS), "pattern"))) \
        .select("__id", "pattern")


def pattern_join(texts: DataFrame, patterns: DataFrame, *, id_col: str = "row_id", text_col: str = "text",
                 most: int = BROADCAST_ROWS) -> DataFrame:
    """(``id_col``, pattern, other columns of ``patterns``) of every pattern found in a text, without regard to case.

    ``patterns`` has a column ``pattern`` of regular expressions; null patterns match nothing, a repeated pattern of
    other columns gives a row for each.  Null text is empty.  A pattern with an alternative without a fragment has to be
    tested on every text: those are a scan with one expression each, so a table should hold few of them.  ``id_col``
    names rows; rows that share an id are one text each and their hits are merged.  Up to ``most`` fragments and keys of
    patterns are held by each task.
    """
    patterns = materialise(patterns)  # they may be drawn from the texts
    known = patterns.where("pattern is not null").select("pattern").distinct()
    rows = texts.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    parts = materialise(_fragments_of_patterns(known))
    wanted = materialise(parts.where("fragment is not null").select("fragment").distinct())
    held = rows.select("__id", "__text", F.explode(_fragments(folded(F.col("__text")))).alias("fragment"))
    # counts of the fragments that patterns could use; a fragment that no text holds is the best key of all
    if few(wanted, most):
        counts = _counts(rows, sorted(r.fragment for r in wanted.collect()))
    else:
        counts = held.join(wanted, "fragment", "left_semi").groupBy("fragment").agg(F.count(F.lit(1)).alias("n"))
    ranked = parts.join(counts, "fragment", "left").groupBy("pattern", "alternative").agg(
        F.min(F.when(F.col("fragment").isNotNull(), F.struct(F.coalesce("n", F.lit(0)).alias("n"), "fragment"))).alias("best"))
    keys = materialise(ranked.select("pattern", F.col("best.fragment").alias("fragment")))
    open_ = sorted(r.pattern for r in keys.where("fragment is null").select("pattern").distinct().collect())
    closed = keys.join(keys.where("fragment is null").select("pattern"), "pattern", "left_anti").distinct()
    if few(closed, most):
        found = _tested(rows, closed)
    else:
        lists = closed.groupBy("fragment").agg(F.collect_set("pattern").alias("__patterns"))
        met = held.join(F.broadcast(lists), "fragment") if few(lists) else join_skewed(held, lists, "fragment", "inner", spread_by="__id")
        found = met.select("__id", "__text", F.explode("__patterns").alias("pattern")) \
            .where(F.regexp_like("__text", F.concat(F.lit(_FLAGS), "pattern"))).select("__id", "pattern")
    if open_:
        tests = [F.when(F.col("__text").rlike(_FLAGS + p), F.lit(p)) for p in open_]
        found = found.unionByName(rows.select("__id", F.explode(F.array_compact(F.array(*tests))).alias("pattern")))
    return found.distinct().join(patterns, "pattern").withColumnRenamed("__id", id_col)
