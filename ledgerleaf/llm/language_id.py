"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1, drawn from its code point alone.  An n-gram is bound from
the vectors of its letters, each permuted (rolled) by its distance from the end.  A document is the bundle (sum) of its
n-grams, a language the bundle of the n-grams of all its documents.  The nearest language by cosine wins.

Texts are lower-cased; what is no letter is a blank, and a run of blanks is one.  A batch is a count
matrix of documents by n-grams, so bundling is a matrix product, made for ``CELLS`` counts at a time.  Learning adds whole numbers, so its
result does not depend on the partitioning; the profiles are languages x ``DIMENSIONS`` numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerleaf.llm.common import read
from ledgerleaf.llm.pretokens import LETTER, class_table

DIMENSIONS, N = 1024, 3
UNKNOWN = "und"
SLAB_CHARS, SLAB_DOCS = 1_000_000, 256
#: N-grams whose vectors are laid out at a time, numbers of these vectors, and counts.
BLOCK, BLOCK_CELLS, CELLS = 2_048, 2_000_000, 1_000_000
NESTED_CELLS, NESTED_SHARE = 8_000_000, 4


@lru_cache(8_192)
def letter_vector(point: int, dimensions: int) -> np.ndarray:
    draws = np.random.default_rng([7, point]).integers(0, 2, dimensions, np.int8)
    return draws * np.int8(2) - np.int8(1)


class Slab:
    """The n-grams of some texts, and their bundles by text or by group of texts."""

    def __init__(self, texts: list[str], n: int = N) -> None:
        joined = "".join(f" {t.lower()} " for t in texts)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        sizes = np.fromiter((len(t.lower()) + 2 for t in texts), np.int64, len(texts))
        owner = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
        letter = class_table()[points] == LETTER
        keep = letter.copy()
        keep[1:] |= letter[:-1] | (owner[1:] != owner[:-1])  # a blank after a letter, or the first of a text
        keep[0] = True
        points, owner, letter = points[keep], owner[keep], letter[keep]
        self.lettered = np.bincount(owner, letter, len(texts)) > 0
        codes, self.points = pd.factorize(np.where(letter, points, np.uint32(0x20)))
        k = len(self.points)
        last = len(codes) - n + 1
        key = np.zeros(max(last, 0), np.int64)
        for i in range(n):
            key = key * k + codes[i: i + len(key)]
        inside = owner[: len(key)] == owner[n - 1: n - 1 + len(key)]
        found, grams = pd.factorize(key[inside])
        self.parts = [(grams // k**(n - 1 - i)) % k for i in range(n)]
        self.found, self.owner, self.grams, self.texts = found, owner[: len(key)][inside], len(grams), len(texts)

    def bundle(self, group: np.ndarray, groups: int, dimensions: int, kind: type) -> np.ndarray:
        """Sums of the n-grams' vectors, (groups x dimensions); ``group`` is that of each text.

        Counts are dense for as many n-grams as fit ``CELLS``, so memory does not grow with groups x n-grams.
        """
        letters = np.stack([letter_vector(int(p), dimensions) for p in self.points])
        n = len(self.parts)
        rolled = [np.roll(letters, n - 1 - i, axis=1) for i in range(n)]
        own = group[self.owner].astype(np.int64)
        block = max(1, min(BLOCK, BLOCK_CELLS // dimensions))
        width = max(1, CELLS // max(groups, 1) // block) * block
        out = np.zeros((groups, dimensions), kind)
        for first in range(0, self.grams, width):
            here = min(width, self.grams - first)
            in_ = slice(None) if here == self.grams else (self.found >= first) & (self.found < first + here)
            counts = np.bincount(own[in_] * here + (self.found[in_] - first), minlength=groups * here).reshape(groups, here)
            for a in range(first, first + here, block):
                b = min(a + block, first + here)
                bound = rolled[0][self.parts[0][a:b]]
                for i in range(1, n):
                    bound = bound * rolled[i][self.parts[i][a:b]]
                out += counts[:, a - first: b - first].astype(kind) @ bound.astype(kind)
        return out

    def bundles(self, dimensions: int) -> np.ndarray:
        """``bundle`` of each text by itself; short texts have too few of the n-grams for a product of matrices."""
        if NESTED_SHARE * len(self.found) < self.texts * self.grams:
            return self.nested(dimensions)
        return self.bundle(np.arange(self.texts), self.texts, dimensions, np.float32)

    def nested(self, dimensions: int) -> np.ndarray:
        """``bundle`` of each text by itself, text by text.

        Where a text differs from the one before in fewer n-grams than it has, as one does from its own beginning, its sum
        is that one's and the difference.  ``NESTED_CELLS`` numbers are laid out at a time.
        """
        letters = np.stack([letter_vector(int(p), dimensions) for p in self.points])
        n, out = len(self.parts), np.zeros((self.texts, dimensions), np.float32)
        rolled = [np.roll(letters, n - 1 - i, axis=1) for i in range(n)]
        grams = max(self.grams, 1)
        own, times = np.unique(self.owner.astype(np.int64) * grams + self.found, return_counts=True)
        here = own + grams < self.texts * grams
        both, at = np.unique(np.concatenate([own, own[here] + grams]), return_inverse=True)
        change = np.bincount(at, np.concatenate([times, -times[here]]), len(both))
        both, change = both[change != 0], change[change != 0]
        cuts = [np.searchsorted(x, np.arange(self.texts + 1) * grams) for x in (own, both)]
        less = np.diff(cuts[1]) < np.diff(cuts[0])
        parts = [(own % grams, times.astype(np.float32)), (both % grams, change.astype(np.float32))]
        width = max(1, NESTED_CELLS // grams)
        for a in range(0, dimensions, width):
            bound = rolled[0][self.parts[0], a: a + width]
            for i in range(1, n):
                bound = bound * rolled[i][self.parts[i], a: a + width]
            bound = bound.astype(np.float32)
            for r in range(self.texts):
                k = int(less[r])
                gram, factor = (x[cuts[k][r]: cuts[k][r + 1]] for x in parts[k])
                out[r, a: a + width] = factor @ bound[gram]
                if k:
                    out[r, a: a + width] += out[r - 1, a: a + width]
        return out


def slabs(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of some rows at a time; null texts are empty."""
    sizes = pc.fill_null(pc.utf8_length(column), 0).to_pylist()
    begin = size = 0
    for i, n in enumerate(sizes):
        size += n
        if size >= SLAB_CHARS or i + 1 - begin == SLAB_DOCS or i + 1 == len(sizes):
            yield begin, [t or "" for t in column.slice(begin, i + 1 - begin).to_pylist()]
            begin, size = i + 1, 0


def learn(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", dimensions: int = DIMENSIONS,
          n: int = N) -> dict[str, np.ndarray]:
    """Profiles of all languages in ``docs``; rows without text or language teach nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for begin, texts in slabs(batch.column("text")):
                slab = Slab(texts, n)
                own, names = pd.factorize(np.array(langs[begin: begin + len(texts)], object))
                # sums of so few ones are exact in single precision
                bundles = slab.bundle(own, len(names), dimensions, np.float32 if len(slab.found) < 1 << 24 else np.float64)
                for name, bundle in zip(names, bundles, strict=True):
                    sums[name] = sums.get(name, 0) + bundle.astype(np.int64)
            if len(sums) > 256:
                yield _rows(sums)
                sums = {}
        if sums:
            yield _rows(sums)

    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")) \
        .where("text is not null and lang is not null")
    parts = rows.mapInArrow(run, "lang string, bundle array<long>").select("lang", F.posexplode("bundle").alias("i", "v"))
    sums = parts.groupBy("lang", "i").agg(F.sum("v").alias("v"))
    profiles = sums.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("x"))
    return {r.lang: np.array([x.v for x in r.x], float)
            for r in profiles.orderBy("lang").collect()}  # languages x dimensions


def _rows(sums: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array(
        [v.tolist() for v in sums.values()], pa.list_(pa.int64()))], ["lang", "bundle"])


def predict(docs: DataFrame, profiles: dict[str, np.ndarray], *, text_col: str = "text", lang_out: str = "lang_pred",
            score_out: str = "score", n: int = N) -> DataFrame:
    """``docs`` with the nearest language and its cosine (0 where it is negative).

    ``und`` with score 0 where the text is null or has no letter, or where no language was learned.  Ties go to
    the first language by name.  Other columns pass through; columns named like the two new ones are replaced.
    """
    docs = docs.drop(lang_out, score_out)
    names = sorted(profiles)
    dimensions = len(profiles[names[0]]) if names else DIMENSIONS
    shared = docs.sparkSession.sparkContext.broadcast(
        np.stack([profiles[x] / max(np.linalg.norm(profiles[x]), 1e-300) for x in names]) if names else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit = shared.value
        for batch in batches:
            langs, scores = [], []
            for _, texts in slabs(batch.column(text_col)):
                if unit is None:
                    langs += [UNKNOWN] * len(texts)
                    scores += [0.0] * len(texts)
                    continue
                slab = Slab(texts, n)
                bundles = slab.bundles(dimensions).astype(float)
                cosine = bundles @ unit.T / np.maximum(np.linalg.norm(bundles, axis=1), 1e-300)[:, None]
                best = cosine.argmax(axis=1)
                for i, has in enumerate(slab.lettered.tolist()):
                    langs.append(names[best[i]] if has else UNKNOWN)
                    scores.append(float(np.clip(cosine[i, best[i]], 0, 1)) if has else 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                                             [*batch.schema.names, lang_out, score_out])

    schema = T.StructType([*docs.schema.fields, T.StructField(lang_out, T.StringType()),
                           T.StructField(score_out, T.DoubleType())])
    return docs.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """Whether a document takes no part in learning; a null id counts as an empty one."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from two thirds of them."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    profiles = learn(docs.where(~held_out(F.col("doc_id"))))
    return predict(docs.select("doc_id", "text"), profiles).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


QUERIES = {"op1_language_id": query}
