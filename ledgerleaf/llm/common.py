"""What the operators of this package share."""

from __future__ import annotations

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerleaf.plans.storage import new_path

#: A word: a maximal run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
BROADCAST_ROWS = 200_000
#: Schemes under which Spark writes, and Arrow's for the same store.
SCHEMES = {"s3a": "s3", "s3n": "s3"}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def arrow_uri(path: str) -> str:
    """A path with Spark's name of an object store mapped to Arrow's."""
    scheme, mark, rest = path.partition("://")
    return f"{SCHEMES.get(scheme, scheme)}{mark}{rest}"


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(arrow_uri(path))


def uniform(*parts: Column, seed: int) -> Column:
    """A draw from (0, 1) that depends on the values alone, so reruns and retried tasks agree."""
    bits = F.shiftrightunsigned(F.xxhash64(*parts, F.lit(seed)), 11)
    return (bits.cast("double") + 0.5) / float(1 << 53)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether a table has at most ``rows`` rows; reads no more than that."""
    return df.limit(rows + 1).count() <= rows


def sql_crc32(text: str) -> str:
    """DuckDB SQL of the unsigned crc32 of an ASCII text; per byte one step takes it in and seven follow with zeros."""
    steps = f"flatten(list_transform(string_split({text}, ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))"
    step = "lambda s, e: xor(xor(s, e) >> 1, 3988292384::BIGINT * (xor(s, e) & 1))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {steps}), {step}), 4294967295::BIGINT)"


#: Whether Spark deletes a query's shuffle files at its end, not when the driver's garbage is collected.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Stored:
    """A table written to the shared folder: columns compressed, lineage cut, gone when it is dropped.

    What was shuffled to make it goes when it is written.
    """

    def __init__(self, df: DataFrame, name: str) -> None:
        self.spark, self.path = df.sparkSession, new_path(df.sparkSession, name)
        self.add(df)

    def add(self, df: DataFrame) -> None:
        """Appends rows of the same columns."""
        before = self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.mode("append").parquet(self.path)
        finally:
            self.spark.conf.unset(CLEANUP) if before is None else self.spark.conf.set(CLEANUP, before)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
