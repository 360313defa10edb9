"""Registered queries: one per operator, each over whole tables."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerleaf import fixed_values as fv
from ledgerleaf.config import CategorizerConfig
from ledgerleaf.functions import lexicon as lx
from ledgerleaf.functions import text as tx
from ledgerleaf.operators import features as ft
from ledgerleaf.operators import feedback as fb
from ledgerleaf.operators import labels as lb
from ledgerleaf.operators import patterns as pt
from ledgerleaf.operators import quality as dq
from ledgerleaf.operators import reports as rp
from ledgerleaf.operators import sampling as sp
from ledgerleaf.operators import scoring as sc
from ledgerleaf.operators import taxonomy as ta
from ledgerleaf.operators import thresholds as th
from ledgerleaf.plans.categorizer import Categorizer, CategorizerModel, calibration_pairs
from ledgerleaf.plans.storage import materialise, new_path
from ledgerleaf.sources import readers, writers
from ledgerleaf.sources.statements import LABELS, load, spread, statements
from ledgerleaf.streaming import scoring as st

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
NB = CategorizerConfig(coarse_trainer="nb", fine_trainer="nb")
R = 6     # digits of rounded outputs


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


# ---- inputs -------------------------------------------------------------------

def lines(spark: SparkSession, d: str) -> DataFrame:
    """Statement lines with a stable train/test mark, stored once per session."""
    def make():
        path = new_path(spark, "lines")
        split = F.when(tx.draw(F.col("row_id"), "split") < 0.2, "test").otherwise("train")
        statements(spark, d).withColumn("split", split).withColumn("text", F.col("narrative")).write.parquet(path)
        return path

    return spark.read.parquet(_once(spark, d, "lines", make))


def docs(spark: SparkSession, d: str) -> DataFrame:
    return spread(load(spark, d, "documents").select(F.col("doc_id").alias("row_id"), "text"), "row_id")


def feedback_log(spark: SparkSession, d: str) -> DataFrame:
    """Review decisions derived from the event log."""
    n = load(spark, d, "orders").agg(F.count(F.lit(1)).alias("n")).scalar()
    kind = F.col("event_type")
    return load(spark, d, "events").select(
        (F.col("event_id") % n).alias("row_id"), "event_id", "ts",
        F.when(kind.isin("error", "view"), "Corrected").otherwise("Accepted").alias("status"),
        F.when(kind == "error", "FEES").when(kind == "view", "").alias("corrected_label"))


_MEMO: dict = {}


def _once(spark: SparkSession, d: str, what: str, make):
    key = (spark.sparkContext.applicationId, d, what)
    if key not in _MEMO:
        _MEMO[key] = make()
    return _MEMO[key]


def nb_model(spark: SparkSession, d: str) -> CategorizerModel:
    """Naive Bayes model of the training lines, fitted once per session."""
    return _once(spark, d, "nb", lambda: Categorizer(NB).fit(
        lines(spark, d).where(F.col("split") == "train"), label="category_id"))


def full_model(spark: SparkSession, d: str) -> CategorizerModel:
    return _once(spark, d, "full", lambda: Categorizer().fit(
        lines(spark, d).where(F.col("split") == "train"), label="category_id"))


def scored(spark: SparkSession, d: str) -> DataFrame:
    """All lines with predictions, stored once per session; reports read this table."""
    def make():
        path = new_path(spark, "scored")
        nb_model(spark, d).transform(lines(spark, d), explain=True, details=True).write.parquet(path)
        return path

    return spark.read.parquet(_once(spark, d, "scored", make))


# ---- sources and sinks ----------------------------------------------------------

@query
def scan_transactions(spark, d):
    path = new_path(spark, "transactions")
    columns = readers.RAW_TRANSACTION_SCHEMA.names
    writers.write_csv(statements(spark, d).select(*columns), path)
    return readers.read_transactions(spark, path)


@query
def scan_csv_roundtrip(spark, d):
    path = new_path(spark, "documents")
    writers.write_csv(docs(spark, d), path)
    back = readers.read_csv(spark, path, docs(spark, d).schema, multi_line=True)
    return back.select("row_id", F.length("text").alias("n_chars"), F.md5("text").alias("digest"))


@query
def row_count(spark, d):
    path = new_path(spark, "documents")
    writers.write_csv(docs(spark, d), path)
    return readers.read_csv(spark, path, docs(spark, d).schema, multi_line=True).agg(F.count(F.lit(1)).alias("total_rows"))


@query
def text_lines(spark, d):
    return readers.text_lines(docs(spark, d), "text")


@query
def text_column(spark, d):
    return readers.non_blank(statements(spark, d), "merchant_name")


@query
def scored_output(spark, d):
    path = new_path(spark, "output")
    inputs = ["row_id", "transaction_id", "narrative"]
    source = lines(spark, d).select(*inputs)
    out = nb_model(spark, d).transform(source, text="narrative")
    writers.scored_output(out, inputs).write.parquet(path)
    return spark.read.parquet(path)


@query
def predictions_json(spark, d):
    return writers.predictions_json(scored(spark, d))


@query
def display_projection(spark, d):
    return writers.display_projection(scored(spark, d), limit=40)


@query
def review_queue(spark, d):
    return rp.review_queue(scored(spark, d), "true_label", "text")


@query
def metrics_summary(spark, d):
    s = scored(spark, d)
    return rp.metrics_summary(s.where(F.col("split") == "test"), s.where(F.col("split") == "train"), "true_label", "label")


@query
def preds_sink(spark, d):
    """All test lines with prediction, probability and explanation, written and read back."""
    path = new_path(spark, "preds")
    test = scored(spark, d).where(F.col("split") == "test")
    writers.write_csv(writers.predictions(test, ["row_id"], "true_label"), path)
    schema = T.StructType([T.StructField("row_id", T.LongType()), T.StructField("label", T.StringType()),
                           T.StructField("pred", T.StringType()), T.StructField("pred_proba", T.DoubleType()),
                           T.StructField("explain", T.StringType())])
    return readers.read_csv(spark, path, schema).withColumn("explain", F.coalesce("explain", F.lit("")))


@query
def confusion_sink(spark, d):
    """The confusion matrix with labels on both axes, written and read back as (truth, pred, n)."""
    path = new_path(spark, "confusion")
    writers.write_csv(rp.confusion_wide(scored(spark, d), "true_label", "label"), path)
    back = spark.read.option("header", True).csv(path)
    names = [c for c in back.columns if c != "truth"]
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("pred"), F.col(c).cast("long").alias("n")) for c in names]))
    return back.select("truth", cells.alias("x")).select("truth", "x.pred", "x.n").where("n > 0")


@query
def metrics_sink(spark, d):
    """The metrics record with all six fields, written as JSON and read back; timings only have to be positive."""
    path = new_path(spark, "metrics")
    s = scored(spark, d)
    test, train = s.where(F.col("split") == "test"), s.where(F.col("split") == "train")
    model, out = nb_model(spark, d), new_path(spark, "timed")
    start = time.perf_counter()  # the scoring of the test lines alone, which the figures divide by
    model.transform(lines(spark, d).where(F.col("split") == "test"), explain=True, details=True).write.parquet(out)
    rp.metrics_summary(test, train, "true_label", "label", time.perf_counter() - start).coalesce(1).write.json(path)
    return spark.read.json(path).select(
        "macro_f1", "accuracy", "n_train", "n_test",
        ((F.col("throughput_tx_per_s") > 0) & (F.col("latency_ms_per_tx") > 0)).alias("timed"))


@query
def texts_scored(spark, d):
    """Distinct non-blank merchant names as literal texts: predictions with explanations as JSON lines."""
    rows = readers.non_blank(statements(spark, d), "merchant_name").distinct()
    return writers.predictions_json(nb_model(spark, d).transform(rows, explain=True)).select(
        F.get_json_object("json", "$.text").alias("text"), F.get_json_object("json", "$.label").isNotNull().alias("labelled"))


@query
def taxonomy_dim(spark, d):
    """The label dimension read with its declared schema, next to the lines of each label."""
    dim = ta.read_taxonomy(spark, ta.stored_default(spark))
    n = statements(spark, d).groupBy(F.col("category_id").alias("id")).agg(F.count(F.lit(1)).alias("n_lines"))
    return dim.join(n, "id", "left").select("id", "display_name", F.col("group").alias("label_group"), "parent_id",
                                            "budget_bucket", "tax_relevant", F.coalesce("n_lines", F.lit(0)).alias("n_lines"))


# ---- projections and predicates ---------------------------------------------------

@query
def pick_columns(spark, d):
    return lb.labelled_view(statements(spark, d)).select("row_id", "raw_text", "label", "__weight__")


@query
def fine_to_coarse(spark, d):
    return lb.fine_to_coarse(statements(spark, d), "category_id", lb.hierarchy_table(spark)).select(
        "row_id", "category_id", "coarse")


@query
def bucket_rows(spark, d):
    return lb.bucket_rows(statements(spark, d), "category_id", lb.hierarchy_table(spark), "TRAVEL").select(
        "row_id", "category_id")


@query
def needs_review(spark, d):
    return scored(spark, d).select("row_id", "fitted", "confidence", "coarse_confidence", "needs_review")


# ---- text -------------------------------------------------------------------------

@query
def normalize_text(spark, d):
    return docs(spark, d).select("row_id", tx.normalize_text(F.col("text")).alias("normalized"))


@query
def stop_tokens(spark, d):
    token = statements(spark, d).select(F.explode(tx.raw_tokens(F.col("narrative"))).alias("token"))
    kind = F.when(F.col("token").isin(*fv.NOISE_TOKENS), "noise").when(
        F.col("token").isin(*fv.CITY_STOP), "city").otherwise("kept")
    return token.groupBy("token").agg(F.count(F.lit(1)).alias("total")).select("token", kind.alias("kind"), "total")


@query
def word_tokens(spark, d):
    words = tx.word_tokens(tx.tokens(F.col("text")))
    return docs(spark, d).select("row_id", F.size(words).alias("n_words"), F.array_join(words, " ").alias("words"))


def _gram_counts(spark, d, grams):
    toks = docs(spark, d).select(tx.tokens(F.col("text")).alias("toks"))
    return toks.select(F.explode(grams(F.col("toks"))).alias("term")).groupBy("term").agg(
        F.count(F.lit(1)).alias("total"))


@query
def word_ngrams(spark, d):
    return _gram_counts(spark, d, lambda t: tx.prefixed(tx.word_ngrams(tx.word_tokens(t)), tx.WORD_PREFIX))


@query
def char_ngrams(spark, d):
    return ft.char_gram_totals(docs(spark, d).select(tx.tokens(F.col("text")).alias("toks")), NB)


@query
def lexicon_match(spark, d):
    buckets = {f"hit_{b}": c for b, c in lx.bucket_hits(F.col("narrative")).items()}
    coarse = {f"coarse_{k}": c for k, c in lx.coarse_hits(F.col("narrative")).items()}
    return statements(spark, d).select("row_id", *[c.alias(n) for n, c in {**buckets, **coarse}.items()])


@query
def lexicon_join(spark, d):
    return statements(spark, d).select("row_id", F.explode(lx.pattern_hits(F.col("narrative"))).alias("h")).groupBy(
        F.col("h.bucket").alias("bucket")).agg(F.count(F.lit(1)).alias("hits"), F.count_distinct("row_id").alias("n_lines"))


@query
def lexicon_table(spark, d):
    """Lexicon, nations and merchants as one table of patterns, and how many lines each is found in."""
    rows = [(b, p) for b, ps in fv.LEXICON.items() for p in ps]
    names = load(spark, d, "nation").select(F.lit("nation").alias("bucket"), F.concat(F.lit("\\b"), "n_name", F.lit("\\b")).alias("pattern"))
    merchants = statements(spark, d).where(F.col("merchant_name").rlike("^[A-Za-z0-9 ]+$")).select(
        F.lit("merchant").alias("bucket"), F.lower("merchant_name").alias("pattern")).distinct()
    table = spark.createDataFrame(rows, "bucket string, pattern string").unionByName(names).unionByName(merchants)
    return pt.pattern_join(statements(spark, d), table, text_col="narrative").groupBy("bucket", "pattern").agg(
        F.count(F.lit(1)).alias("n_lines"))


@query
def hard_override(spark, d):
    rule = lx.override_rule(F.col("narrative"))
    return statements(spark, d).withColumn("rule", rule).select(
        "row_id", "category_id", "rule", lx.apply_override(F.col("category_id"), F.col("rule")).alias("label"))


@query
def explain_parse(spark, d):
    parts = tx.parse_explanation(F.col("explanation"))
    return scored(spark, d).select("row_id", F.size(parts).alias("n_parts"), F.array_join(parts, "|").alias("parts"))


@query
def compose_narrative(spark, d):
    return statements(spark, d).select("row_id", "channel", "reference", "narrative")


@query
def reference_extract(spark, d):
    found = tx.extract_reference(F.col("narrative"))
    return statements(spark, d).select("row_id", *[c.alias(n) for n, c in found.items()])


@query
def augment_text(spark, d):
    return statements(spark, d).select(
        "row_id", tx.swapped_words(F.col("narrative"), F.col("row_id")).alias("swapped"),
        tx.dropped_letter(F.col("narrative"), F.col("row_id")).alias("dropped"))


# ---- features -----------------------------------------------------------------------

@query
def term_freq(spark, d):
    return ft.term_freq(ft.keyed(lines(spark, d), "row_id", "text"), NB, branches=("w",))


@query
def doc_freq(spark, d):
    return ft.doc_freq(ft.term_freq(ft.keyed(docs(spark, d), "row_id", "text"), NB, grouped=True), NB)


@query
def vocabulary(spark, d):
    return ft.vocabulary(ft.doc_freq(ft.term_freq(ft.keyed(docs(spark, d), "row_id", "text"), NB, grouped=True), NB), NB)


@query
def idf(spark, d):
    return ft.fit_vocabulary(docs(spark, d), NB).select("term", "df", F.round("idf", R).alias("idf"))


def _tfidf(spark, d, branch):
    source = lines(spark, d)
    tf = ft.term_freq(ft.keyed(source, "row_id", "text"), NB, branches=(branch,), grouped=True)
    vocab = ft.fit_vocabulary(source, NB, branches=(branch,))
    return ft.tfidf(tf, vocab, NB, digits=R).select("row_id", "term", "value")


@query
def tfidf_word(spark, d):
    return _tfidf(spark, d, "w")


@query
def tfidf_char(spark, d):
    return _tfidf(spark, d, "c")


def _per_branch(values, rows):
    """Sums per row and branch; zeros where a row has no known term."""
    sums = values.groupBy("row_id", ft.branch_of(F.col("term")).alias("branch")).agg(
        F.count(F.lit(1)).alias("n_terms"), F.round(F.sum("value"), R).alias("l1"),
        F.round(F.sum(F.col("value") * F.col("value")), R).alias("l2"), F.round(F.max("value"), R).alias("peak"))
    every = rows.select("row_id", F.explode(F.array(*map(F.lit, ft.BRANCHES))).alias("branch"))
    return every.join(sums, ["row_id", "branch"], "left").na.fill(0, ["n_terms", "l1", "l2", "peak"])


@query
def tfidf_union(spark, d):
    source = docs(spark, d)
    tf = ft.term_freq(ft.keyed(source, "row_id", "text"), NB, grouped=True)
    return _per_branch(ft.tfidf(tf, ft.fit_vocabulary(source, NB), NB), source)


@query
def tfidf_transform(spark, d):
    """Vocabulary of the training lines, applied to every line."""
    source = lines(spark, d)
    vocab = materialise(ft.fit_vocabulary(source.where(F.col("split") == "train"), NB))
    n_words = vocab.where(F.col("term").startswith(tx.WORD_PREFIX)).count()
    vectors = ft.vectorize(source.select("row_id", "text"), vocab, NB)
    branches = {"w": lambda x: x["indices"] < n_words, "c": lambda x: x["indices"] >= n_words}
    add = lambda e, power: F.aggregate(e, F.lit(0.0), lambda a, x: a + (x["values"] if power == 1 else x["values"] * x["values"]))
    per_branch = []
    for name, inside in branches.items():
        own = F.col(f"e_{name}")
        vectors = vectors.withColumn(f"e_{name}", F.filter(F.arrays_zip("features.indices", "features.values"), inside))
        per_branch.append(F.struct(
            F.lit(name).alias("branch"), F.size(own).cast("long").alias("n_terms"), F.round(add(own, 1), R).alias("l1"),
            F.round(add(own, 2), R).alias("l2"), F.round(F.coalesce(F.array_max(F.transform(own, lambda x: x["values"])), F.lit(0.0)), R).alias("peak")))
    return vectors.select("row_id", F.inline(F.array(*per_branch)))


# ---- labels, counts, samples -----------------------------------------------------------

@query
def label_union(spark, d):
    s = lines(spark, d)
    return lb.label_union(s.where(F.col("split") == "train"), s.where(F.col("split") == "test"), "category_id")


@query
def unmapped_labels(spark, d):
    return lb.unmapped_labels(statements(spark, d), "category_id", lb.hierarchy_table(spark))


@query
def augment_hierarchy(spark, d):
    return lb.augment_hierarchy(statements(spark, d), "category_id", lb.hierarchy_table(spark))


@query
def class_weights(spark, d):
    return lb.class_weights(statements(spark, d), "category_id").withColumn("weight", F.round("weight", R))


@query
def fine_bucket_kind(spark, d):
    return lb.bucket_kinds(statements(spark, d), "category_id")


@query
def train_test_split(spark, d):
    test = F.floor(F.col("n") / 5)
    return sp.train_test_split(statements(spark, d), "row_id", F.col("n") - test, test).select("row_id", "band")


@query
def calibration_sample(spark, d):
    source = statements(spark, d).withColumn("coarse", lb.coarse_of(F.col("category_id")))
    coarse = sp.coarse_calibration_sample(source, "row_id").select("row_id", F.lit("coarse").alias("level"), "coarse")
    fine = sp.fine_calibration_sample(source, "row_id", "coarse").select("row_id", F.lit("fine").alias("level"), "coarse")
    return coarse.unionByName(fine)


@query
def stratified_allocation(spark, d):
    return sp.stratified_allocation(statements(spark, d), "row_id", "category_id", 3_000).select("row_id", "category_id")


# ---- models ---------------------------------------------------------------------------

@query
def nb_fit(spark, d):
    m = nb_model(spark, d)
    return m.terms.select("term", F.inline(F.array(*[
        F.struct(F.lit(c).alias("cls"), F.round(F.col("w")[i], R).alias("weight"))
        for i, c in enumerate(m.coarse_classes)])))


@query
def linear_scores(spark, d):
    m = nb_model(spark, d)
    s = sc.linear_scores(lines(spark, d), m.table, m.width, NB)
    return s.select("row_id", *[F.round(F.col("scores")[i], R).alias(f"score_{c}") for i, c in enumerate(m.coarse_classes)])


def _probabilities(spark, d, make=nb_model):
    return make(spark, d).probabilities(lines(spark, d))


@query
def nb_proba(spark, d):
    m = nb_model(spark, d)
    return _probabilities(spark, d).select("row_id", *[F.col("coarse_p")[i].alias(f"p_{c}") for i, c in enumerate(m.coarse_classes)])


@query
def argmax_class(spark, d):
    classes = nb_model(spark, d).coarse_classes
    return _probabilities(spark, d).select("row_id", sc.argmax_class(F.col("coarse_p"), classes).alias("cls"))


@query
def coarse_boost(spark, d):
    m = nb_model(spark, d)
    out = sc.coarse_boost(_probabilities(spark, d), m.coarse_classes, NB, digits=R)
    return out.select("row_id", *[F.col("boosted_p")[i].alias(f"p_{c}") for i, c in enumerate(m.coarse_classes)])


@query
def apply_thresholds(spark, d):
    m = nb_model(spark, d)
    table = spark.createDataFrame(list(m.coarse_thresholds.items()), "cls string, threshold double")
    top = sc.coarse_boost(_probabilities(spark, d), m.coarse_classes, NB, digits=R).select(
        "row_id", sc.argmax_class(F.col("boosted_p"), m.coarse_classes).alias("cls"), F.array_max("boosted_p").alias("p"))
    return th.apply_thresholds(top, "cls", "p", table).withColumn("threshold", F.round("threshold", R))


@query
def coarse_route(spark, d):
    m = nb_model(spark, d)
    return sc.route(_probabilities(spark, d), NB, m.coarse_classes, m.coarse_thresholds).select(
        "row_id", "coarse_top", "coarse_confidence", "coarse_label")


@query
def fine_decide(spark, d):
    return nb_model(spark, d).decide(_probabilities(spark, d)).select(
        "row_id", "coarse_label", "fine_class", "label_raw", "rule", "label", "confidence")


@query
def threshold_floor(spark, d):
    """Thresholds the model calibrated, floors applied."""
    m = nb_model(spark, d)
    rows = [("coarse", "", c, t) for c, t in m.coarse_thresholds.items()]
    rows += [("fine", b, c, t) for b in m.fitted_buckets for c, t in m.buckets[b].thresholds.items()]
    found = spark.createDataFrame(rows, "level string, bucket string, cls string, threshold double")
    n = statements(spark, d).where(F.col("category_id").isNotNull()).groupBy(F.col("category_id").alias("cls")).agg(
        F.count(F.lit(1)).alias("n_rows"))
    return found.join(n, "cls", "left").withColumn("threshold", F.round("threshold", R))


def _pairs(spark, d, *levels):
    """Pairs of all lines for each level; a line is scored once."""
    m = nb_model(spark, d)
    source = lines(spark, d).withColumn("coarse", lb.coarse_of(F.col("category_id"))).withColumn("label", F.col("category_id"))
    level = F.lit(levels[0]) if len(levels) == 1 else F.explode(F.array(*map(F.lit, levels)))
    return calibration_pairs(m.probabilities(source).withColumn("level", level), m)


@query
def threshold_search(spark, d):
    """Newer rule: every coarse class over all lines, and every label over all lines of its bucket."""
    return th.threshold_search(_pairs(spark, d, "coarse", "fine"), ["level", "bucket", "cls"]).withColumns(
        {"best_f1": F.round("best_f1", R), "threshold": F.round("threshold", R)})


@query
def threshold_search_v6(spark, d):
    found = th.threshold_search(_pairs(spark, d, "coarse"), ["cls"], rule="v6")
    return th.apply_floors(found, "cls", fv.COARSE_FLOORS).withColumns(
        {"best_f1": F.round("best_f1", R), "threshold": F.round("threshold", R)})


@query
def threshold_search_v6_fine(spark, d):
    """Older rule with its floors: every label over all lines of its bucket."""
    found = th.threshold_search(_pairs(spark, d, "fine"), ["bucket", "cls"], rule="v6")
    degenerate = (F.col("positives") == 0) | (F.col("positives") == F.col("n"))
    floored = th.apply_floors(found.where(~degenerate), "cls", fv.FINE_FLOORS_V6).unionByName(found.where(degenerate))
    return floored.withColumns({"best_f1": F.round("best_f1", R), "threshold": F.round("threshold", R)})


@query
def score_nb(spark, d):
    return nb_model(spark, d).transform(lines(spark, d).select("row_id", "text", "true_label", "split"))


@query
def explain_topk(spark, d):
    m = nb_model(spark, d)
    return m.explain(m.decide(_probabilities(spark, d))).where("explanation is not null").select("row_id", "explanation")


#: Share of lines whose coarse bucket (or label, before overrides) a trained model has to get right.
COARSE_FLOOR, LABEL_FLOOR = 0.9, 0.85


def _facts(rows, right, proper, floor):
    """Per true label: rows, rows with proper output; and whether the model reaches the floor over all rows."""
    share = F.sum(F.sum(right.cast("int"))).over(W.partitionBy()) / F.sum(F.count(F.lit(1))).over(W.partitionBy())
    return rows.groupBy("true_label").agg(
        F.count(F.lit(1)).alias("total_rows"), F.sum(proper.cast("int")).alias("proper_rows"), (share >= floor).alias("accurate"))


def _sums_to_one(p):
    return F.abs(F.aggregate(p, F.lit(0.0), lambda a, x: a + x) - 1) < 1e-5


def _router_facts(spark, d, m):
    p = m.probabilities(lines(spark, d))
    found = sc.argmax_class(F.col("coarse_p"), m.coarse_classes)
    return _facts(p, found == lb.coarse_of(F.col("true_label")), _sums_to_one("coarse_p"), COARSE_FLOOR)


@query
def coarse_lr(spark, d):
    return _router_facts(spark, d, full_model(spark, d))


@query
def coarse_ovr(spark, d):
    cfg = CategorizerConfig(coarse_trainer="ovr", fine_trainer="nb")
    return _router_facts(spark, d, _once(spark, d, "ovr", lambda: Categorizer(cfg).fit(
        lines(spark, d).where(F.col("split") == "train"), label="category_id")))


@query
def coarse_sgd(spark, d):
    """The router of mini-batch descent on all lines."""
    cfg = CategorizerConfig(coarse_trainer="sgd", fine_trainer="nb")
    return _router_facts(spark, d, _once(spark, d, "sgd", lambda: Categorizer(cfg).fit(
        lines(spark, d).where(F.col("split") == "train"), label="category_id")))


#: A fit counts as finished when its gradient is below this share of the gradient before it; the loose coarse tolerance ends there.
GRADIENT_SHARE = 0.05


@query
def fit_certificate(spark, d):
    """Every logistic head of the full model: training rows per class, its share of the weighted probabilities, which balanced
    weights make equal at the optimum, and whether the gradient over all rows is near zero."""
    facts = full_model(spark, d).certificate()
    return facts.select("bucket", "cls", "n_rows", F.round("mass", 2).alias("mass"),
                        (F.col("gradient") <= GRADIENT_SHARE * F.col("start")).alias("stationary"))


@query
def fine_ensemble(spark, d):
    """The Bayes half of every bucket, and whether the bucket's answer is 0.7 of the other half and 0.3 of this one."""
    m = full_model(spark, d)
    halves = {"nb": [h for h in m.heads if h.bucket and not h.explains], "lr": [h for h in m.heads if h.explains]}
    buckets = m.fitted_buckets
    rows = sc.linear_scores(lines(spark, d).select("row_id", "text"), m.table, m.width, m.cfg)
    whole = sc.with_probabilities(rows, [h for h in m.heads if h.bucket], R)
    for name, heads in halves.items():
        whole = sc.with_probabilities(whole, heads, 9 if name == "lr" else R, prefix=f"{name}_p_")
    linear, bayes = m.cfg.ensemble_weights
    per_bucket = F.array(*[F.struct(
        F.lit(b).alias("bucket"), F.arrays_zip(
            F.array(*[F.lit(c) for c in m.buckets[b].classes]).alias("cls"), F.col(f"nb_p_{b}").alias("nb"),
            F.col(f"lr_p_{b}").alias("lr"), F.col(f"fine_p_{b}").alias("p")).alias("parts")) for b in buckets])
    flat = whole.select("row_id", F.inline(per_bucket)).select("row_id", "bucket", F.inline("parts"))
    mixed = F.abs(F.col("p") - linear * F.col("lr") - bayes * F.col("nb")) < 1e-6
    return flat.select("row_id", "bucket", "cls", F.col("nb").alias("nb_p"), mixed.alias("mixed"))


@query
def score_full(spark, d):
    """All lines with explanations, reduced to facts per label."""
    m = full_model(spark, d)
    out = m.transform(lines(spark, d).select("row_id", "text", "true_label"), explain=True, details=True)
    due = F.col("needs_review") & F.col("fitted") & (F.col("text").isNotNull())
    proper = F.col("confidence").between(0, 1) & F.col("label").isNotNull() & (F.col("explanation").isNull() | due)
    return _facts(out, F.col("label_raw") == F.col("true_label"), proper, LABEL_FLOOR)


@query
def model_roundtrip(spark, d):
    path = new_path(spark, "model")
    nb_model(spark, d).save(path)
    return CategorizerModel.load(spark, path).transform(lines(spark, d).select("row_id", "text", "true_label", "split"))


# ---- reports --------------------------------------------------------------------------

@query
def accuracy_macro_f1(spark, d):
    return rp.accuracy_macro_f1(scored(spark, d), "true_label", "label", ("split",))


@query
def classification_report(spark, d):
    return rp.classification_report(scored(spark, d), "true_label", "label", ("split",))


@query
def confusion_long(spark, d):
    return rp.confusion_long(scored(spark, d), "true_label", "label", ("split",))


@query
def confusion_wide(spark, d):
    return rp.confusion_wide(scored(spark, d), "true_label", "label", sorted(LABELS))


@query
def flagged_pct(spark, d):
    return rp.flagged_pct(scored(spark, d), ("split",))


@query
def batch_summary(spark, d):
    return rp.batch_summary(scored(spark, d))


@query
def override_impact(spark, d):
    return rp.override_impact(scored(spark, d), "true_label")


@query
def feedback_latest(spark, d):
    return fb.feedback_latest(feedback_log(spark, d)).select("row_id", "event_id", "status", "corrected_label")


@query
def feedback_join(spark, d):
    return fb.feedback_join(scored(spark, d), feedback_log(spark, d)).select("row_id", "label", "status", "final_label")


@query
def feedback_accuracy(spark, d):
    return fb.feedback_accuracy(fb.feedback_join(scored(spark, d), feedback_log(spark, d)))


# ---- taxonomy and quality ---------------------------------------------------------------

@query
def taxonomy_enrich(spark, d):
    return ta.taxonomy_enrich(statements(spark, d), "category_id", ta.default_taxonomy(spark)).select(
        "row_id", "category_id", "label_name", "label_group", "budget_bucket", "default_direction", "tax_relevant")


@query
def taxonomy_rollup(spark, d):
    return ta.taxonomy_rollup(statements(spark, d), "category_id", ta.default_taxonomy(spark)).withColumn(
        "amount", F.col("amount").cast("double"))


@query
def hierarchy_rollup(spark, d):
    """Orders below every customer, nation, region and the whole, by the closure of a hierarchy of five levels."""
    name = lambda kind, key: F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))
    steps = [("orders", name("order", "o_orderkey"), name("customer", "o_custkey")),
             ("customer", name("customer", "c_custkey"), name("nation", "c_nationkey")),
             ("nation", name("nation", "n_nationkey"), name("region", "n_regionkey")),
             ("region", name("region", "r_regionkey"), F.lit("all"))]
    edges = [load(spark, d, table).select(node.alias("node"), parent.alias("parent")) for table, node, parent in steps]
    paths = ta.closure(edges[0].unionByName(edges[1]).unionByName(edges[2]).unionByName(edges[3]))
    facts = load(spark, d, "orders").select(name("order", "o_orderkey").alias("node"), F.round("o_totalprice", 2).cast("decimal(18,2)").alias("amount"))
    return ta.rollup(facts, "node", paths, "amount").where("not ancestor like 'order:%'").select(
        "ancestor", "total_rows", F.col("amount").cast("double").alias("amount"), "depth")


@query
def dq_dates(spark, d):
    return dq.date_rules(statements(spark, d)).select("row_id", "post_gap_days", "posted_early", "posted_late")


@query
def dq_amount(spark, d):
    return dq.amount_rules(statements(spark, d)).select("row_id", "low", "high", "out_of_range", "tiny")


@query
def dq_amount_bands(spark, d):
    """The band of each amount, from a table of limits by a range join."""
    return dq.amount_bands(statements(spark, d), dq.limit_bands(spark)).select("row_id", "category_id", "band", "low", "high")


@query
def dq_channel(spark, d):
    return dq.channel_rules(statements(spark, d)).select("row_id", "category_id", "channel", "odd_channel")


@query
def dq_missing(spark, d):
    flags = [f"missing_{c}" for c in dq.OPTIONAL_FIELDS]
    return dq.missing_rules(statements(spark, d)).groupBy("category_id").agg(
        *[F.sum(F.col(c).cast("int")).alias(c) for c in flags])


@query
def dq_currency(spark, d):
    return dq.currency_rules(statements(spark, d)).where("foreign_currency").select("row_id", "currency")


@query
def dq_label_name(spark, d):
    return dq.label_name_rules(statements(spark, d), ta.default_taxonomy(spark)).where("name_mismatch").select(
        "row_id", "category_id", "category_display_name", "expected_name")


@query
def dq_direction(spark, d):
    return dq.direction_rules(statements(spark, d), ta.default_taxonomy(spark)).select(
        "row_id", "dr_cr", "label_group", "direction_mismatch", "unlabelled_refund")


@query
def dq_duplicates(spark, d):
    return dq.duplicate_rules(statements(spark, d)).where("duplicate").select("row_id", "transaction_id", "copies")


@query
def dq_summary(spark, d):
    return dq.summary(dq.check(statements(spark, d), ta.default_taxonomy(spark)))


# ---- streaming ------------------------------------------------------------------------

def _stream_run(spark, d) -> tuple[str, str]:
    """Lines as CSV files, scored by a stream, then totalled by a second one."""
    root = new_path(spark, "stream")
    source = lines(spark, d).select("row_id", "transaction_id", "narrative")
    writers.write_csv(source, f"{root}/in")  # a file for each part of the lines, so none grows with the table
    model = nb_model(spark, d)
    arriving = readers.read_csv_stream(spark, f"{root}/in", source.schema)
    st.score_stream(arriving, model, f"{root}/scored", f"{root}/state/score", text="narrative").awaitTermination()
    schema = spark.read.parquet(f"{root}/scored").schema
    st.running_totals(spark, f"{root}/scored", schema, f"{root}/totals", f"{root}/state/totals").awaitTermination()
    return f"{root}/scored", f"{root}/totals"


@query
def stream_scored_output(spark, d):
    return spark.read.parquet(_once(spark, d, "stream", lambda: _stream_run(spark, d))[0])


@query
def stream_totals(spark, d):
    return st.read_published(spark, _once(spark, d, "stream", lambda: _stream_run(spark, d))[1])


# ---- flagship ---------------------------------------------------------------------------

@query
def labelled_counts(spark, d):
    """Lines per category after normalising, lexicon matching and overrides."""
    hits = lx.bucket_hits(F.col("narrative"))
    any_hit = F.lit(False)
    for c in hits.values():
        any_hit = any_hit | c
    marked = statements(spark, d).select(
        "category_id", "amount", tx.normalize_text(F.col("narrative")).alias("normalized"), any_hit.alias("hit"),
        lx.hard_override(F.col("category_id"), F.col("narrative")).alias("label"))
    return marked.groupBy("category_id", "label").agg(
        F.count(F.lit(1)).alias("total_rows"), F.count_distinct("normalized").alias("distinct_texts"),
        F.sum(F.col("hit").cast("int")).alias("lexicon_rows"), F.sum("amount").cast("double").alias("amount"))
