"""Label hierarchy, class counts and label sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerleaf import fixed_values as fv


def pick_columns(df: DataFrame) -> tuple[str, str]:
    """Text and label column: the first known pair that the table has."""
    for text, label in (("raw_text", "label"), ("narrative", "category_id"), ("narrative", "category_display_name")):
        if text in df.columns and label in df.columns:
            return text, label
    raise ValueError(f"no text/label column pair found; available: {df.columns}")


def labelled_view(df: DataFrame) -> DataFrame:
    """Rename the resolved pair to raw_text/label and add the constant row weight."""
    text, label = pick_columns(df)
    return df.withColumnsRenamed({text: "raw_text", label: "label"}).withColumn("__weight__", F.lit(1.0))


def hierarchy_table(spark, hierarchy: dict | None = None) -> DataFrame:
    pairs = [(c, f) for c, kids in (hierarchy or fv.HIERARCHY).items() for f in kids]
    return spark.createDataFrame(pairs, "coarse string, fine string")


def fine_to_coarse(df: DataFrame, label: str, hierarchy: DataFrame) -> DataFrame:
    """Add ``coarse``; labels outside the hierarchy fall to the default bucket."""
    side = hierarchy.select(F.col("fine").alias(label), F.col("coarse").alias("__coarse"))
    return df.join(side, label, "left").withColumn(
        "coarse", F.coalesce("__coarse", F.lit(fv.DEFAULT_COARSE))).drop("__coarse")


def bucket_rows(df: DataFrame, label: str, hierarchy: DataFrame, bucket: str) -> DataFrame:
    """Rows whose label belongs to the bucket."""
    kids = hierarchy.where(F.col("coarse") == bucket).select(F.col("fine").alias(label))
    return df.join(kids, label, "left_semi")


def guessed_coarse(label: Column) -> Column:
    """Bucket for a label that the hierarchy in use does not list: its place in the default one, else by name."""
    pairs = [F.lit(x) for c, kids in fv.HIERARCHY.items() for f in kids for x in (f, c)]
    usual = F.try_element_at(F.create_map(*pairs), label)
    out = F.when(usual.isNotNull(), usual).when(label.isin(*fv.GUESSED_SHOPPING), "SHOPPING")
    for prefix, bucket in fv.GUESSED_PREFIX.items():
        out = out.when(label.startswith(prefix), bucket)
    return out.otherwise(fv.DEFAULT_COARSE)


def coarse_of(label: Column, hierarchy: dict | None = None) -> Column:
    """Bucket by the hierarchy, else the guessed one; one literal map, no join."""
    pairs = [F.lit(x) for c, kids in (hierarchy or fv.HIERARCHY).items() for f in kids for x in (f, c)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), label), guessed_coarse(label))


def distinct_labels(df: DataFrame, label: str) -> DataFrame:
    return df.select(F.col(label).alias("label")).distinct()


def label_union(left: DataFrame, right: DataFrame, label: str) -> DataFrame:
    return distinct_labels(left, label).union(distinct_labels(right, label)).distinct().orderBy("label")


def unmapped_labels(df: DataFrame, label: str, hierarchy: DataFrame) -> DataFrame:
    """Labels of the data that the hierarchy lacks."""
    return distinct_labels(df, label).exceptAll(hierarchy.select(F.col("fine").alias("label")).distinct())


def augment_hierarchy(df: DataFrame, label: str, hierarchy: DataFrame) -> DataFrame:
    """Base hierarchy plus guessed buckets of the labels it lacks."""
    missing = unmapped_labels(df, label, hierarchy)
    base = hierarchy.select("coarse", "fine", F.lit("base").alias("origin"))
    extra = missing.select(guessed_coarse(F.col("label")).alias("coarse"), F.col("label").alias("fine"),
                           F.lit("guessed").alias("origin"))
    return base.unionByName(extra)


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weights n / (k * n_c); the window runs over one row per class."""
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.agg(F.struct(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")).alias("s")).scalar()
    return counts.select("label", "n", (totals["n"] / (totals["k"] * F.col("n"))).alias("weight"))


def bucket_kinds(df: DataFrame, label: str, hierarchy: dict | None = None) -> DataFrame:
    """How each coarse bucket is served: fitted, solo or missing."""
    keys = df.sparkSession.createDataFrame([(k,) for k in fv.COARSE_KEYS], "bucket string")
    present = distinct_labels(df, label).select(coarse_of(F.col("label"), hierarchy).alias("bucket"), "label")
    stats = present.groupBy("bucket").agg(F.count(F.lit(1)).alias("n_labels"), F.min("label").alias("first_label"))
    n = F.coalesce(F.col("n_labels"), F.lit(0))
    return keys.join(F.broadcast(stats), "bucket", "left").select(
        "bucket", n.alias("n_labels"),
        F.when(n == 0, "missing").when(n == 1, "solo").otherwise("fitted").alias("kind"),
        F.when(n == 1, F.col("first_label")).alias("solo_label"),
        F.when(n == 1, floor_of(F.col("first_label"), fv.FINE_FLOORS, fv.DEFAULT_THRESHOLD)).alias("solo_threshold"),
    )


def floor_of(cls: Column, floors: dict, default: float | None) -> Column:
    pairs = [F.lit(x) for kv in floors.items() for x in kv]
    found = F.try_element_at(F.create_map(*pairs), cls)
    return found if default is None else F.coalesce(found, F.lit(default))
