"""Score files as they arrive, with the batch plan."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ledgerleaf.plans.categorizer import CategorizerModel
from ledgerleaf.sources.readers import require_columns
from ledgerleaf.sources.writers import scored_output

#: Name of the counts that a scoring stream reports with every batch.
PROGRESS = "scored_rows"


def score_stream(stream: DataFrame, model: CategorizerModel, output: str, checkpoint: str, *, text: str,
                 low_conf: float | None = None) -> StreamingQuery:
    """Score arriving rows and append them to ``output``.

    Scoring is a projection, so Spark's own file sink will do: its log names the files of every
    committed batch, and a batch that is replayed after a failure does not appear twice, neither here nor to readers
    of ``output``.  Each batch reports its counts (see ``progress``); a stream that is stopped goes on after its last batch.
    """
    require_columns(stream, text)
    scored = scored_output(model.transform(stream, text=text, low_conf=low_conf), stream.columns)
    scored = scored.observe(PROGRESS, F.count(F.lit(1)).alias("processed"), F.count_if("needs_review").alias("flagged"))
    return (scored.writeStream.format("parquet").outputMode("append").option("path", output)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def progress(query: StreamingQuery) -> list[tuple[int, int, int]]:
    """(batch, rows processed, rows flagged) of the stream's latest batches."""
    seen = {p["batchId"]: p["observedMetrics"][PROGRESS] for p in query.recentProgress if PROGRESS in p["observedMetrics"]}
    return [(batch, row["processed"], row["flagged"]) for batch, row in sorted(seen.items())]


def publish(batch: DataFrame, batch_id: int, output: str) -> None:
    """Write a batch's table into a folder of its own; its success mark makes it the current one.

    What readers see until then stays as it is.  A batch that is replayed writes another folder with the same
    number and the same rows.  Folders older than the batch before are deleted.
    """
    batch.write.parquet(f"{output}/batch-{batch_id:012d}-{uuid.uuid4().hex}")
    fs, found = _batches(batch.sparkSession, output)
    for number, path in found:
        if number < batch_id - 1:
            fs.delete(path, True)


def read_published(spark: SparkSession, output: str) -> DataFrame:
    """The table of the latest batch that was written to its end."""
    fs, found = _batches(spark, output)
    done = [(number, str(path)) for number, path in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS"))]
    if not done:
        raise ValueError(f"nothing was published in {output}")
    return spark.read.parquet(max(done)[1])


def _batches(spark: SparkSession, output: str):
    root = spark._jvm.org.apache.hadoop.fs.Path(output)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [(s.getPath(), re.fullmatch(r"batch-(\d+)-\w+", s.getPath().getName())) for s in (fs.listStatus(root) if fs.exists(root) else [])]
    return fs, [(int(m[1]), path) for path, m in names if m]


def running_totals(spark: SparkSession, scored_folder: str, schema: T.StructType, output: str,
                   checkpoint: str) -> StreamingQuery:
    """Processed and flagged rows per label over all scored batches; the state has one row per label.

    Every batch publishes all totals so far (see ``read_published``): a replay replaces them and counts nothing twice.
    """
    totals = spark.readStream.schema(schema).parquet(scored_folder).groupBy("coarse_label", "label").agg(
        F.count(F.lit(1)).alias("total_rows"), F.sum(F.col("needs_review").cast("int")).alias("flagged"))
    return (totals.writeStream.outputMode("complete").foreachBatch(lambda batch, n: publish(batch, n, output))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
