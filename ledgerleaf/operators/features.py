"""TF-IDF as DataFrames.

Layout: ``(row_id, term, tf)``, or one row per id with its terms as an array.  A
row's terms never leave the task that owns the row: they are counted as arrays
(``grams``) where the text is.  Only ids that repeat are aggregated.  The
aggregation by term shuffles, after sums in each task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerleaf.config import CategorizerConfig
from ledgerleaf.functions import text as tx
from ledgerleaf.operators import grams as gm
from ledgerleaf.operators.joins import join_bounded
from ledgerleaf.plans.storage import materialise

BRANCHES = ("w", "c")
TERM_BYTES = 96          # a term, its numbers and row overhead
TABLE_LIMIT_BYTES = 256 * 1024 * 1024      # of terms that each task holds


def keyed(df: DataFrame, row_id: str, *columns: str) -> DataFrame:
    """Hash-partition the named columns on ``row_id``.

    The partition count is explicit: the rows grow about a hundredfold in the
    next step, so they must not be merged into few partitions by input size.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.select(row_id, *columns).repartition(n, row_id)


def _ranges(cfg: CategorizerConfig, branches=BRANCHES) -> tuple:
    """Sizes of word and character grams; None for a branch that is not asked for."""
    return cfg.word_ngrams if "w" in branches else None, cfg.char_ngrams if "c" in branches else None


def _by_id(df: DataFrame, row_id: str) -> tuple[DataFrame, DataFrame | None]:
    """The rows whose id is theirs alone, and the others if there are any.  Null ids are equal."""
    repeated = df.groupBy(F.col(row_id).alias("__id")).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
    if repeated.isEmpty():
        return df, None
    marked = df.join(repeated, F.col(row_id).eqNullSafe(F.col("__id")), "left").drop("__id")
    return marked.where("__n is null").drop("__n"), marked.where("__n is not null").drop("__n")


def _mapped(rows: DataFrame, make, fields: str) -> DataFrame:
    """(other columns of ``rows``, *fields), where ``make`` gives (row, columns) of a chunk of ``laid`` texts."""
    rest = [c for c in rows.columns if c != "laid"]
    added = T.StructType.fromDDL(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, part in gm.chunks(batch.column("laid")):
                row, columns = make(part)
                at = pa.array(row + begin)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in rest), *columns], [*rest, *added.names])

    return rows.select(*rest, "laid").mapInArrow(run, T.StructType([*(rows.schema[c] for c in rest), *added.fields]))


def term_freq(df: DataFrame, cfg: CategorizerConfig, *, text: str = "text", row_id: str = "row_id",
              carry: tuple = (), branches=BRANCHES, grouped: bool = False) -> DataFrame:
    """(row_id, *carry, term, tf).  ``df`` should come from ``keyed``.  Rows that share id and ``carry`` count as one.

    With ``grouped`` a row's terms stay laid out in one line, ``laid``, to be counted where ``tfidf`` weighs them; rows that
    share their id have null there and their counts in ``terms``.
    """
    words, chars = _ranges(cfg, branches)

    def counts(part: pa.Array):
        row, gram, names = gm.grams(part, words, chars)
        row, gram, times = gm.counted(row, gram, len(names))
        return row, [names.take(pa.array(gram)), pa.array(times.astype(np.int64))]

    once, again = (rows if rows is None else rows.select(row_id, *carry, row_terms(text, cfg).alias("laid"))
                   for rows in _by_id(df.select(row_id, *carry, text), row_id))
    fields = "term string, tf long"
    out = once if grouped else _mapped(once, counts, fields)
    if again is None:
        return out
    summed = _mapped(again, counts, fields).groupBy(row_id, *carry, "term").agg(F.sum("tf").alias("tf"))
    if not grouped:
        return out.unionByName(summed)
    lists = summed.groupBy(row_id, *carry).agg(F.collect_list(F.struct("term", "tf")).alias("terms"))
    return out.unionByName(lists, allowMissingColumns=True)


def doc_freq(tf: DataFrame, cfg: CategorizerConfig | None = None, branches=BRANCHES) -> DataFrame:
    """(term, df, total): rows that hold the term, and its count over all rows.

    ``tf`` as ``term_freq`` gives it.  Rows that are ``grouped`` are counted under ``cfg`` where they are laid out, and a task
    sends the sums of its rows.
    """
    if "laid" not in tf.columns:
        return tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total"))
    words, chars = _ranges(cfg, branches)
    counts = tf.where("laid is not null").select("laid").mapInArrow(
        lambda batches: gm.partial_counts(batches, words, chars), "term string, df long, total long")
    if "terms" in tf.columns:
        counts = counts.unionByName(doc_freq(tf.where("laid is null").select(F.inline("terms"))))
    return counts.groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))


def _most_frequent(stats: DataFrame, k: int) -> DataFrame:
    """Top ``k`` terms by total count, then by term.

    A histogram over the logarithm of the count (some hundred rows, whatever the
    vocabulary) gives a lower bound of the k-th count, so that only terms near
    the top reach the final sort.
    """
    log_count = F.floor(F.log2("total") * 16)
    histogram = stats.groupBy(log_count.alias("level")).agg(F.count(F.lit(1)).alias("n"))
    above = F.sum("n").over(W.orderBy(F.desc("level"))) - F.col("n")
    lowest = histogram.withColumn("above", above).where(F.col("above") < k).agg(F.min("level").alias("level")).scalar()
    return stats.where(log_count >= lowest).orderBy(F.desc("total"), F.asc("term")).limit(k)


def vocabulary(stats: DataFrame, cfg: CategorizerConfig, branches=BRANCHES) -> DataFrame:
    """(term, df, total, idx): minimum document frequency, then the most frequent
    terms of each branch.  ``idx`` counts the word block, then the character
    block, each in term order; at most ``word_max + char_max`` rows exist.
    ``stats`` are kept, as several cuts read them."""
    stats = materialise(stats)
    limits = {"w": (tx.WORD_PREFIX, cfg.word_min_df, cfg.word_max_features),
              "c": (tx.CHAR_PREFIX, cfg.char_min_df, cfg.char_max_features)}
    parts = [
        _most_frequent(stats.where(F.col("term").startswith(prefix) & (F.col("df") >= min_df)), k)
        for prefix, min_df, k in (limits[b] for b in branches)
    ]
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    order = W.orderBy(F.col("term").startswith(tx.CHAR_PREFIX), F.col("term"))
    return both.withColumn("idx", F.row_number().over(order) - 1)


def with_idf(vocab: DataFrame, n_rows: Column) -> DataFrame:
    """Smoothed inverse document frequency ln((1+n)/(1+df)) + 1."""
    return vocab.withColumn("idf", F.log((n_rows + 1) / (F.col("df") + 1)) + 1)


def row_count(df: DataFrame) -> Column:
    """Number of rows as a scalar subquery."""
    return df.agg(F.count(F.lit(1)).alias("n")).scalar()


def branch_of(term: Column) -> Column:
    return F.substring(term, 1, 1)


def weight(term: Column, tf: Column, idf: Column) -> Column:
    """Sublinear term frequency for words, plain for character grams, times idf."""
    return F.when(term.startswith(tx.WORD_PREFIX), F.log(tf) + 1).otherwise(tf) * idf


def max_terms(cfg: CategorizerConfig) -> int:
    return cfg.word_max_features + cfg.char_max_features


def rounded(value: np.ndarray, digits: int) -> np.ndarray:
    """As Spark's ``round``: halves of a number's shortest decimal form go away from zero."""
    scaled = np.abs(value) * 10.0 ** digits
    below = np.floor(scaled)
    out = np.copysign(np.floor(scaled + 0.5) / 10.0 ** digits, value) + 0.0
    with np.errstate(invalid="ignore"):
        near = np.flatnonzero(np.isfinite(scaled) & (np.abs(scaled - below - 0.5) <= 1e-5 + scaled * 2.0 ** -50))
    for i in near.tolist():  # too near a half to be told by the product
        exact = Decimal(repr(float(value[i])))
        out[i] = float(exact.quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP)) if exact.as_tuple().exponent < -digits else value[i]
    return out


def tfidf(tf: DataFrame, vocab: DataFrame, cfg: CategorizerConfig, *, row_id: str = "row_id", limit: int | None = None,
          digits: int | None = None) -> DataFrame:
    """Weights of known terms scaled to length 1 per row and branch; unknown terms drop out.

    ``tf`` as ``term_freq`` gives it.  Rows that are ``grouped`` are weighed by themselves, as long as a task can hold the
    vocabulary; others are joined with it.  ``digits`` rounds the weights.
    """
    slim = vocab.select("term", "idx", "idf")
    if "laid" in tf.columns:
        rest = [c for c in tf.columns if c not in ("laid", "terms")]
        slim = materialise(slim)
        if fits(slim, limit=TABLE_LIMIT_BYTES if limit is None else limit):
            table = tf.sparkSession.sparkContext.broadcast(Terms.collect(slim))

            def weighed(part: pa.Array):
                row, at, times, value = table.value.weighed(part, cfg)
                value = value if digits is None else rounded(value, digits)
                return row, [table.value.terms.take(pa.array(at)), pa.array(times), pa.array(at.astype(np.int32)), pa.array(value)]

            known = _mapped(tf.where("laid is not null").select(*rest, "laid"), weighed, "term string, tf long, idx int, value double")
            if "terms" not in tf.columns:
                return known
            lists = tf.where("laid is null").select(*rest, F.inline("terms"))
            return known.unionByName(tfidf(lists, slim, cfg, row_id=row_id, digits=digits))

        def counts(part: pa.Array):
            row, gram, names = gm.grams(part, *_ranges(cfg))
            row, gram, times = gm.counted(row, gram, len(names))
            return row, [names.take(pa.array(gram)), pa.array(times.astype(np.int64))]

        flat = _mapped(tf.where("laid is not null").select(*rest, "laid"), counts, "term string, tf long")
        tf = flat if "terms" not in tf.columns else flat.unionByName(tf.where("laid is null").select(*rest, F.inline("terms")))
    joined = join_bounded(tf, slim, "term", max_rows=max_terms(cfg), row_bytes=TERM_BYTES, spread_by=row_id)
    weighed = joined.withColumn("weight", weight(F.col("term"), F.col("tf"), F.col("idf")))
    norm = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(
        W.partitionBy(row_id, branch_of(F.col("term")))))
    value = F.col("weight") / norm
    return weighed.withColumn("value", value if digits is None else F.round(value, digits)).drop("weight", "idf")


def char_gram_totals(toks: DataFrame, cfg: CategorizerConfig, column: str = "toks") -> DataFrame:
    """(term, total) of the character grams in a column of token arrays.

    A gram lies inside one token, so tokens are counted first and each distinct one is expanded once.
    """
    tokens = toks.select(F.explode(column).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    n = int(toks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tokens = tokens.repartition(n, "token")  # a small table of tokens still is a large one of grams
    grams = tx.prefixed(tx.char_ngrams(F.array("token"), *cfg.char_ngrams), tx.CHAR_PREFIX)
    return tokens.select(F.explode(grams).alias("term"), "n").groupBy("term").agg(F.sum("n").alias("total"))


@dataclass
class Terms:
    """Known terms as arrays that a task holds: name, idf and branch by position."""

    terms: pa.Array
    idf: np.ndarray
    is_word: np.ndarray

    @classmethod
    def collect(cls, vocab: DataFrame) -> "Terms":
        """``vocab`` (term, idx, idf), of a size that ``fits`` has to allow."""
        rows = vocab.select("term", "idf").orderBy("idx").toArrow()
        names = rows.column("term").combine_chunks()
        return cls(names, rows.column("idf").to_numpy(), pc.starts_with(names, tx.WORD_PREFIX).to_numpy(zero_copy_only=False))

    def _weights(self, row: np.ndarray, at: np.ndarray, tf: np.ndarray) -> np.ndarray:
        word = self.is_word[at]
        value = np.where(word, 1 + np.log(tf), tf) * self.idf[at]
        part = row * 2 + word
        return value / np.sqrt(np.bincount(part, value * value))[part] if len(part) else value

    def vectors(self, laid: pa.Array, cfg: CategorizerConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, position, value) of all known terms, by row and position; values have length 1 per row and branch.

        ``laid`` as ``row_terms`` gives it.
        """
        found = []
        for begin, part in gm.chunks(laid):
            row, at, _, value = self.weighed(part, cfg)
            found.append((row + begin, at, value))
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return tuple(np.concatenate(x) for x in zip(none, *found))

    def weighed(self, part: pa.Array, cfg: CategorizerConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, position, times, value) of a chunk."""
        row, gram, names = gm.grams(part, *_ranges(cfg))
        at = pc.fill_null(pc.index_in(names, value_set=self.terms), -1).to_numpy()[gram]
        known = at >= 0
        row, at, tf = gm.counted(row[known], at[known], len(self.terms))
        return row, at, tf, self._weights(row, at, tf)


def fits(terms: DataFrame, width: int = 0, limit: int = TABLE_LIMIT_BYTES) -> bool:
    """Whether a task can hold the terms with ``width`` weights each; counts the table, which the configuration bounds."""
    return terms.count() * (TERM_BYTES + 8 * width) <= limit


def row_terms(text: str, cfg: CategorizerConfig) -> Column:
    """A row's tokens laid out for ``grams``."""
    return gm.laid_out(tx.tokens(F.col(text), cfg.stop_tokens))


def vectorize(df: DataFrame, vocab: DataFrame, cfg: CategorizerConfig, *, text: str = "text", row_id: str = "row_id",
              limit: int = TABLE_LIMIT_BYTES) -> DataFrame:
    """Add ``features``: the positions of a row's known terms, ascending, and their TF-IDF weights.

    A row is handled by itself, without a shuffle, as long as a task can hold the names and idf of all terms; a larger
    vocabulary joins the rows' terms, with the same result.  Rows without known terms have empty arrays.
    """
    if not fits(vocab, limit=limit):
        values = tfidf(term_freq(keyed(df, row_id, text), cfg, text=text, row_id=row_id), vocab, cfg, row_id=row_id)
        entries = values.groupBy(row_id).agg(F.array_sort(F.collect_list(F.struct("idx", "value"))).alias("__e"))
        none = F.array().cast("array<struct<idx:int,value:double>>")
        e = F.coalesce("__e", none)
        return df.join(entries, row_id, "left").withColumn("features", F.struct(
            F.transform(e, lambda x: x["idx"]).alias("indices"), F.transform(e, lambda x: x["value"]).alias("values"))).drop("__e")
    table = df.sparkSession.sparkContext.broadcast(Terms.collect(vocab))

    @F.arrow_udf("struct<indices:array<int>,values:array<double>>")
    def vectors(laid: pa.Array) -> pa.Array:
        row, at, value = table.value.vectors(laid, cfg)
        ends = pa.array(np.searchsorted(row, np.arange(len(laid) + 1)).astype(np.int32))
        arrays = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (at.astype(np.int32), value)]
        return pa.StructArray.from_arrays(arrays, ["indices", "values"])

    return df.withColumn("features", vectors(row_terms(text, cfg)))


def fit_vocabulary(df: DataFrame, cfg: CategorizerConfig, *, text: str = "text", row_id: str = "row_id",
                   branches=BRANCHES) -> DataFrame:
    """Vocabulary with idf of a text table; each task sums the counts of its rows, and rows that share their id count as one."""
    tf = term_freq(keyed(df, row_id, text), cfg, text=text, row_id=row_id, branches=branches, grouped=True)
    return with_idf(vocabulary(doc_freq(tf, cfg, branches), cfg, branches), row_count(df))
