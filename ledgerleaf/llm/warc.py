"""WARC archives: a writer that is Spark's text writer, and a data source that reads headers first.

Writing.  A record is its header, the HTTP head and the payload, and the text writer ends it with the two empty lines
that the format wants as its line separator.  So the files are plain WARC 1.1, any file
system that Spark writes will do, and Spark's commit protocol covers lost executors.  Of equal payloads one
record holds the payload, the others are ``revisit`` records that name it.

Reading.  ``WarcSource`` plans one partition per group of files.  Predicates on record type, digest, address and other
headers are pushed down and tested on the header, those on payload size on the HTTP head behind it; the payload of a
record that fails them, or that nobody asked for (option ``payload``), is stepped over and never decoded.  A record
without a length, and one that its file ends within, is an error that names file and byte.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    LessThan,
    LessThanOrEqual,
    StringContains,
    StringEndsWith,
    StringStartsWith,
)

from ledgerleaf.llm.common import file_system, read, small
from ledgerleaf.operators.joins import join_skewed
from ledgerleaf.plans.storage import new_path

END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BATCH_ROWS, BATCH_BYTES = 512, 8_000_000
PARTITION_BYTES = 64_000_000
SCHEMA = """record_id string, record_type string, target_uri string, date string, refers_to string, content_type string,
payload_digest string, payload_bytes long, payload binary, file string, offset long"""


def base32_sha1(value: Column) -> Column:
    """SHA-1 of bytes in upper-case base 32: four times 40 bits, written in base 32 and renamed."""
    digest = F.sha1(value)
    parts = [F.lpad(F.upper(F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 32)), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def mark_revisits(pages: DataFrame, *, id_col: str = "page_id", payload_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """``pages`` with __bytes, __digest, __refers (the id of the record that holds the payload, null for itself).

    Of records with equal payloads of at least ``min_bytes`` bytes the one with the largest id holds it; rows
    that share this id all do.  A null payload is empty.  A null id refers to the largest known one; where all are null, none refers.
    """
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = pages.drop("__bytes", "__digest", "__refers").withColumns(
        {"__bytes": F.octet_length(payload).cast("long"), "__digest": base32_sha1(payload)})
    holders = (rows.where(F.col("__bytes") >= min_bytes).groupBy("__digest")
               .agg(F.max(id_col).alias("__holder"), F.count(F.lit(1)).alias("__n")).where("__n > 1").drop("__n"))
    if small(holders):
        joined = rows.join(F.broadcast(holders), "__digest", "left")
    else:
        joined = join_skewed(rows, holders, "__digest", "left", spread_by=id_col)
    other = F.col("__holder").isNotNull() & ~F.col(id_col).eqNullSafe(F.col("__holder")) & (F.col("__bytes") >= min_bytes)
    return joined.withColumn("__refers", F.when(other, F.col("__holder"))).drop("__holder")


def record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


def write_warc(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
               date: str = "2024-01-01T00:00:00Z", min_bytes: int = 0, records_per_file: int = 20_000) -> None:
    """One record per row; line breaks in addresses become blanks, a null address is left out."""
    rows = mark_revisits(pages, id_col=id_col, payload_col=payload_col, min_bytes=min_bytes)
    body = F.coalesce(F.col(payload_col), F.lit(""))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.col("__bytes").cast("string"), F.lit(END))
    revisit = F.col("__refers").isNotNull()
    block = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("__bytes"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    url = F.regexp_replace(F.col(url_col), r"[\r\n]+", " ")
    head = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", record_id(F.col(id_col))), line("WARC-Date", F.lit(date)),
        F.when(url.isNull(), F.lit("")).otherwise(line("WARC-Target-URI", url)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "__digest")),
        F.when(revisit, F.concat(line("WARC-Refers-To", record_id(F.col("__refers"))), line("WARC-Profile", F.lit(PROFILE))))
        .otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")), line("Content-Length", block.cast("string")))
    record = F.concat(head, F.lit("\r\n"), http, F.when(revisit, F.lit("")).otherwise(body))
    rows.select(record.alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", records_per_file).text(path)


class Files(InputPartition):
    def __init__(self, files: list[str]) -> None:
        self.value = files


#: A test of a header value, by the class of the predicate; the value is never null.
TESTS: dict[type, Callable] = {
    EqualTo: lambda v, x: v == x, In: lambda v, x: v in x, GreaterThan: lambda v, x: v > x,
    GreaterThanOrEqual: lambda v, x: v >= x, LessThan: lambda v, x: v < x, LessThanOrEqual: lambda v, x: v <= x,
    StringStartsWith: lambda v, x: v.startswith(x), StringContains: lambda v, x: x in v,
    StringEndsWith: lambda v, x: v.endswith(x), IsNotNull: lambda v, x: True,
}
HEADERS = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "date": "warc-date",
           "refers_to": "warc-refers-to", "content_type": "content-type", "payload_digest": "warc-payload-digest"}


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: bool) -> None:
        self.path, self.payload = path, payload
        self.tests: list[tuple[str, type, object]] = []
        self.sizes: list[tuple[type, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if type(f) in TESTS and column in HEADERS:
                self.tests.append((HEADERS[column], type(f), getattr(f, "value", None)))
            elif type(f) in TESTS and column == "payload_bytes":
                self.sizes.append((type(f), getattr(f, "value", None)))
            else:
                yield f

    def partitions(self) -> list[Files]:
        """Files by name, several small ones together; a file is never split, as records have no sync mark."""
        store, folder = file_system(self.path)
        found = store.get_file_info(fs.FileSelector(folder, recursive=True))
        out, held = [[]], 0
        for info in sorted((i for i in found if i.is_file and i.base_name[0] not in "._"), key=lambda i: i.path):
            if out[-1] and held + info.size > PARTITION_BYTES:
                out.append([])
                held = 0
            out[-1].append(info.path)
            held += info.size
        return [Files(x) for x in out]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = file_system(self.path)
        rows, held = [], 0
        for file in partition.value:
            for row in self.records(store, file):
                rows.append(row)
                held += len(row[8] or b"")
                if len(rows) >= BATCH_ROWS or held >= BATCH_BYTES:
                    yield _batch(rows)
                    rows, held = [], 0
        if rows:
            yield _batch(rows)

    def records(self, store: fs.FileSystem, file: str) -> Iterator[tuple]:
        raw = store.open_input_file(file)
        end = raw.size()
        zipped = raw.read(2) == b"\x1f\x8b"
        raw.seek(0)
        data = io.BufferedReader(gzip.GzipFile(fileobj=raw) if zipped else raw, 1 << 20)
        at = 0
        while True:
            line = data.readline()
            while line in (b"\r\n", b"\n"):
                at += len(line)
                line = data.readline()
            if not line:
                return
            if not line.startswith(b"WARC/"):
                raise ValueError(f"{file}, byte {at}: no WARC record begins here")
            begin, head, size = at, {}, len(line)
            while (line := data.readline()) not in (b"\r\n", b"\n", b""):
                name, _, value = line.decode("utf-8", "replace").partition(":")
                head[name.strip().lower()] = value.strip()
                size += len(line)
            size += len(line)
            if not head.get("content-length", "").isdigit():
                raise ValueError(f"{file}, byte {begin}: a record without Content-Length")
            length = int(head["content-length"])
            at += size + length
            if all(name in head and TESTS[kind](_value(name, head[name]), x) for name, kind, x in self.tests):
                row = self.row(data, head, length, file, begin)
            else:
                row = data.seek(length, io.SEEK_CUR) and None
            if (data.tell() if zipped else end) < at:
                raise ValueError(f"{file}, byte {begin}: the file ends within this record")
            if row:
                yield row

    def row(self, data: io.BufferedReader, head: dict[str, str], length: int, file: str, begin: int) -> tuple | None:
        """The record, or None where its payload size fails a predicate; either way the whole record is passed."""
        left, payload, full = length, None, length
        if head.get("content-type", "").startswith("application/http"):
            while left > 0 and (line := data.readline(left)):
                left -= len(line)
                name, _, value = line.partition(b":")
                if name.strip().lower() == b"content-length":
                    full = int(value)
                if line in (b"\r\n", b"\n"):
                    break
            if head.get("warc-type") != "revisit":
                full = left
        fits = all(TESTS[kind](full, x) for kind, x in self.sizes)
        if fits and self.payload and head.get("warc-type") != "revisit":
            payload = data.read(left)
        else:
            data.seek(left, io.SEEK_CUR)
        return None if not fits else (*(_value(h, head[h]) if h in head else None for h in HEADERS.values()), full, payload, file, begin)


def _value(name: str, text: str) -> str:
    return text.removeprefix("sha1:") if name == "warc-payload-digest" else text


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in SCHEMA.split(",")]
    kinds = [pa.string()] * 7 + [pa.int64(), pa.binary(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


class WarcSource(DataSource):
    """``spark.read.format("warc").option("payload", "false").load(path)``; .warc and .warc.gz files."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], self.options.get("payload", "true").lower() == "true")


def read_warc(spark: SparkSession, path: str, *, payload: bool = True) -> DataFrame:
    """Records below ``path``.  Sets ``spark.sql.python.filterPushdown.enabled``, without which nothing is pushed down.

    ``payload`` is null for revisits and where it was not asked for; ``payload_bytes`` is that of the full payload.
    Headers that a record lacks are null; a folder without archives gives an empty table.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def page_id(urn: Column) -> Column:
    return F.regexp_extract(urn, "^<urn:page:(.*)>$", 1).try_cast("long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as archives and read back by record type: payloads of responses, for their sizes and digests, and
    headers alone of revisits."""
    path = new_path(spark, "warc")
    write_warc(read(spark, sf_dir, "pages"), path)
    held = read_warc(spark, path).where("record_type = 'response'").select(
        page_id(F.col("record_id")).alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"),
        base32_sha1(F.col("payload")).alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    named = read_warc(spark, path, payload=False).where("record_type = 'revisit'").select(
        page_id(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        page_id(F.col("refers_to")).alias("refers_to"))
    return held.unionByName(named)


QUERIES = {"op4_warc": query}
