"""Token-id files: one zstandard frame per document, a dictionary shared by all.

A dictionary is trained on the serialized ids of a bounded sample (``SAMPLE_DOCS`` documents of at most
``SAMPLE_CHARS`` characters, by hash order).  Documents are cut into shards by id range; a shard is one file:

    magic | sha-256 of the dictionary | bytes per id | frames ... | index | index offset, documents | magic

The index holds the offset of each frame (one more than documents), the ids and the token counts of the documents,
so one document is read with three small reads.  Files are written under a name of their task attempt;
only those that the manifest names count, and the manifest is a table that Spark commits.

The tokenizers library's model encodes each distinct word of a chunk once; words are cut by `pretokens`.
"""

from __future__ import annotations

import hashlib
import os
import struct
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerleaf.llm.bpe import PairIndexEncoder, byte_symbols, chunked, default_vocabulary
from ledgerleaf.llm.common import file_system, read, uniform
from ledgerleaf.plans.storage import new_path

MAGIC = b"LLTOKIDS"
SAMPLE_DOCS, SAMPLE_CHARS, DICTIONARY_BYTES = 1_000, 20_000, 64 * 1024
SHARD_DOCS, MAX_SHARDS = 4_096, 100_000
LEVEL = 3
#: Texts of so many characters are encoded at a time.
CHUNK_CHARS = 8_000_000


class LibraryEncoder(PairIndexEncoder):
    """Words go to the tokenizers library's model instead of the pair index."""

    def __init__(self, content: bytes) -> None:
        from tokenizers import Tokenizer

        super().__init__(content)
        self.model = Tokenizer.from_str(content.decode()).model
        self.shown = {b: ord(c) for b, c in byte_symbols().items()}

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        tokenize, shown = self.model.tokenize, self.shown
        ids = [[t.id for t in tokenize(w.encode().decode("latin-1").translate(shown))] for w in words]
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter((i for own in ids for i in own), np.uint32, int(counts.sum())), counts


@lru_cache(2)
def library_encoder(content: bytes) -> LibraryEncoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return LibraryEncoder(content)


@lru_cache(2)
def dictionary_of(content: bytes) -> zstandard.ZstdCompressionDict:
    return zstandard.ZstdCompressionDict(content)


def id_type(size: int) -> np.dtype:
    """Two bytes an id where the vocabulary allows it."""
    return np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")


def train_dictionary(docs: DataFrame, bpe: LibraryEncoder, *, id_col: str, text_col: str, end_id: int) -> bytes:
    """Dictionary content; b"" where the sample is too small to train on, then frames stand alone."""
    chance = min(1.0, 1.5 * SAMPLE_DOCS / max(1, docs.count()))  # so that tasks together give the driver about a sample
    sample = (docs.select(F.col(text_col).alias("text"), uniform(F.col(id_col), seed=10).alias("h"))
              .where((F.col("h") <= chance) & F.length("text").between(1, SAMPLE_CHARS)).orderBy("h", "text").limit(SAMPLE_DOCS))
    texts = [r.text for r in sample.collect()]
    kind = id_type(bpe.size)
    rows = [np.append(x, np.uint32(end_id)).astype(kind).tobytes() for x in bpe.encode_batch(texts)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, rows).as_bytes()
    except zstandard.ZstdError:
        return b""


def shard_bounds(docs: DataFrame, id_col: str, shard_docs: int) -> list[int]:
    """Upper id of every shard but the last, from the id column alone; at most MAX_SHARDS numbers."""
    n = docs.count()
    shards = max(1, min(MAX_SHARDS, -(-n // shard_docs)))
    if shards == 1:
        return []
    at = [i / shards for i in range(1, shards)]
    found = docs.agg(F.percentile_approx(id_col, at, 10 * shards).alias("at")).first().at
    return sorted(set(found or []))


def write_ids(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0,
              vocabulary: str | None = None, shard_docs: int = SHARD_DOCS) -> str:
    """Encode ``docs`` and write them in ascending order of id below ``path``; gives the manifest's path.

    Null text is empty; each document ends with ``end_id``.  Ids are whole numbers; a null id comes first.  Rows
    that share an id stay next to each other, in the order of their ids' bytes.  Other columns are not stored.
    An empty table gives an empty manifest.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    with open(vocabulary or default_vocabulary(), "rb") as f:
        content = f.read()
    bpe = library_encoder(content)
    dictionary = train_dictionary(docs, bpe, id_col="doc_id", text_col="text", end_id=end_id)
    digest = hashlib.sha256(dictionary).digest()
    store, folder = file_system(path)
    store.create_dir(folder, recursive=True)
    with store.open_output_stream(f"{folder}/{digest.hex()}.dict") as out:
        out.write(dictionary)
    shared = spark.sparkContext.broadcast((content, dictionary, np.array(shard_bounds(docs, "doc_id", shard_docs), np.int64)))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        content, dictionary, bounds = shared.value
        bpe = library_encoder(content)
        kind = id_type(bpe.size)
        pack = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True,
                                        dict_data=dictionary_of(dictionary) if dictionary else None).compress
        for batch, texts in chunked(batches, "text", CHUNK_CHARS):
            ids = [np.append(x, np.uint32(end_id)) for x in bpe.encode_batch(texts)]
            own = batch.column("doc_id")
            known = own.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [own, pa.array(np.searchsorted(bounds, known), pa.int32()), pa.array(map(len, ids), pa.int64()),
                 pa.array([pack(x.astype(kind).tobytes()) for x in ids], pa.binary())],
                ["doc_id", "shard", "n_tokens", "frame"])

    frames = docs.mapInArrow(encode, "doc_id long, shard int, n_tokens long, frame binary")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    ordered = frames.repartition(parts, "shard").sortWithinPartitions("shard", "doc_id", "n_tokens", "frame")
    width = id_type(bpe.size).itemsize

    def store_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = file_system(path)
        writer = None
        for batch in batches:
            shards = batch.column("shard").to_numpy()
            cuts = [0, *(np.flatnonzero(shards[1:] != shards[:-1]) + 1).tolist(), len(shards)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if b == a:
                    continue
                if writer is None or writer.shard != shards[a]:
                    if writer:
                        yield writer.close()
                    writer = ShardWriter(store, folder, int(shards[a]), digest, width)
                writer.add(batch.slice(a, b - a))
        if writer:
            yield writer.close()

    manifest = f"{path}/manifest"
    ordered.mapInArrow(store_shards, "shard int, file string, documents long, tokens long, first_id long, last_id long") \
        .write.parquet(manifest)
    return manifest


class ShardWriter:
    """Streams frames to a file; holds only the index of its documents."""

    def __init__(self, store: fs.FileSystem, folder: str, shard: int, digest: bytes, width: int) -> None:
        self.shard, self.file = shard, f"shard-{shard:06d}-{uuid.uuid4().hex}.ids"
        self.out = store.open_output_stream(f"{folder}/{self.file}")
        self.out.write(MAGIC + digest + struct.pack("<Q", width))
        self.offset = len(MAGIC) + 40
        self.offsets, self.ids, self.tokens = [self.offset], [], []

    def add(self, rows: pa.RecordBatch) -> None:
        for frame in rows.column("frame"):
            raw = frame.as_py()
            self.out.write(raw)
            self.offset += len(raw)
            self.offsets.append(self.offset)
        self.ids += rows.column("doc_id").to_pylist()
        self.tokens += rows.column("n_tokens").to_pylist()

    def close(self) -> pa.RecordBatch:
        none = np.iinfo(np.int64).min
        self.out.write(np.array(self.offsets, "<u8").tobytes()
                       + np.array([none if i is None else i for i in self.ids], "<i8").tobytes()
                       + np.array(self.tokens, "<u8").tobytes() + struct.pack("<QQ", self.offset, len(self.ids)) + MAGIC)
        self.out.close()
        row = {"shard": self.shard, "file": self.file, "documents": len(self.ids), "tokens": sum(self.tokens),
               "first_id": self.ids[0], "last_id": self.ids[-1]}
        kinds = [pa.int32(), pa.string(), *[pa.int64()] * 4]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row.values(), kinds, strict=True)], list(row))


class ShardReader:
    """Documents of a file by place; nothing but the index is read beforehand."""

    def __init__(self, store: fs.FileSystem, folder: str, file: str) -> None:
        self.data = store.open_input_file(f"{folder}/{file}")
        size = self.data.size()
        head, foot = self.data.read_at(len(MAGIC) + 40, 0), self.data.read_at(len(MAGIC) + 16, size - len(MAGIC) - 16)
        if not head.startswith(MAGIC) or not foot.endswith(MAGIC):
            raise ValueError(f"{file} is no token-id file")
        begin, n = struct.unpack_from("<QQ", foot)
        index = self.data.read_at(8 * (3 * n + 1), begin)
        self.offsets = np.frombuffer(index, "<u8", n + 1)
        self.ids, self.tokens = np.frombuffer(index, "<i8", n, 8 * (n + 1)), np.frombuffer(index, "<u8", n, 8 * (2 * n + 1))
        digest = head[len(MAGIC): len(MAGIC) + 32]
        with store.open_input_file(f"{folder}/{digest.hex()}.dict") as f:
            dictionary = f.read()
        if hashlib.sha256(dictionary).digest() != digest:
            raise ValueError(f"the dictionary of {file} has been changed")
        self.kind = np.dtype(f"<u{struct.unpack('<Q', head[-8:])[0]}")
        self.unpack = zstandard.ZstdDecompressor(dict_data=dictionary_of(dictionary) if dictionary else None).decompress

    def document(self, i: int) -> np.ndarray:
        a, b = int(self.offsets[i]), int(self.offsets[i + 1])
        return np.frombuffer(self.unpack(self.data.read_at(b - a, a)), self.kind).astype("<u4")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids) of the files below ``path``; ids are little-endian unsigned 32-bit integers."""
    manifest = spark.read.parquet(f"{path}/manifest")
    # one row per shard, MAX_SHARDS at most
    before = F.sum("tokens").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1))
    files = manifest.withColumn("begin", F.coalesce(before, F.lit(0)))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    files = files.select("file", "begin").repartition(parts, "file")

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = file_system(path)
        for batch in batches:
            for file, begin in zip(batch.column("file").to_pylist(), batch.column("begin").to_pylist(), strict=True):
                shard = ShardReader(store, folder, file)
                starts = begin + np.cumsum(shard.tokens) - shard.tokens
                for a in range(0, len(shard.ids), 256):
                    b = min(a + 256, len(shard.ids))
                    own = shard.ids[a:b]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(own, mask=own == np.iinfo(np.int64).min), pa.array(starts[a:b].astype(np.int64)),
                         pa.array([shard.document(i).tobytes() for i in range(a, b)], pa.binary())],
                        ["doc_id", "start", "ids"])

    return files.mapInArrow(load, "doc_id long, start long, ids binary")


def read_documents(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The rows of a few documents: only shards that may hold one are opened, only their frames are unpacked."""
    wanted = sorted(set(doc_ids))
    shards = spark.read.parquet(f"{path}/manifest")
    near = F.exists(F.array(*map(F.lit, wanted)), lambda x: x.between(F.col("first_id"), F.col("last_id")))
    shared = spark.sparkContext.broadcast(np.array(wanted, np.int64))

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = file_system(path)
        for batch in batches:
            for file in batch.column("file").to_pylist():
                shard = ShardReader(store, folder, file)
                at = np.flatnonzero(np.isin(shard.ids, shared.value)).tolist()
                yield pa.RecordBatch.from_arrays([pa.array(shard.ids[at]), pa.array(
                    [shard.document(i).tobytes() for i in at], pa.binary())], ["doc_id", "ids"])

    return shards.where(near).select("file").mapInArrow(load, "doc_id long, ids binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place and digest, from the files written."""
    path = new_path(spark, "token-ids")
    write_ids(read(spark, sf_dir, "documents"), path)
    return read_ids(spark, path).select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"),
                                        F.crc32("ids").alias("ids_crc32"))


QUERIES = {"op10_token_files": query}
