"""Byte-pair encoding and decoding with a pair occurrence index.

A partition's texts are cut into words (`pretokens`), equal words are encoded once.  All distinct words
lie in one array of symbols with links to the left and right.  The index maps the rank of every pair
that occurs to all its positions.  A heap holds the active ranks; the lowest is merged at all its
positions at once, and only the lists of the pairs beside them are updated.  New pairs go onto the
heap, so the order within each word is that of merging its lowest pair first, whatever the ranks.

Each partition is encoded by itself: no shuffle, and a lost task is simply run again.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerleaf.llm.common import read
from ledgerleaf.llm.pretokens import Words, pieces

NONE = np.int32(2**31 - 1)
#: Texts of so many characters share an index; their words' symbols are what a task holds.
CHUNK_CHARS = 4_000_000
SPLIT_CHARS = 1_000_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in the vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class PairIndexEncoder:
    """Encodes texts and decodes ids of a byte-level vocabulary file."""

    def __init__(self, content: bytes) -> None:
        spec = json.loads(content)
        vocab: dict[str, int] = spec["model"]["vocab"]
        symbols = byte_symbols()
        self.byte_id = np.array([vocab[symbols[b]] for b in range(256)], np.int32)
        self.size = max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.left = np.array([vocab[a] for a, _ in merges], np.int32)
        self.right = np.array([vocab[b] for _, b in merges], np.int32)
        self.new = np.array([vocab[a + b] for a, b in merges], np.int32)
        keys = self.left.astype(np.int64) * self.size + self.right
        self.order = np.argsort(keys, kind="stable").astype(np.int32)
        self.keys = keys[self.order]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.added_at = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") \
            if self.added else None
        back = {c: b for b, c in symbols.items()}
        self.bytes_of = [b""] * self.size
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        for token, i in self.added.items():
            self.bytes_of[i] = token.encode()

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], NONE)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and how many each word has."""
        raw = [w.encode() for w in words]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        symbol = self.byte_id[np.frombuffer(b"".join(raw), np.uint8)]
        begin = np.cumsum(lengths) - lengths
        self._merge(symbol, begin)
        kept = symbol >= 0
        return symbol[kept].astype(np.uint32), np.add.reduceat(kept, begin, dtype=np.int64)

    def _merge(self, symbol: np.ndarray, begin: np.ndarray) -> None:
        n = len(symbol)
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        after[begin[1:] - 1], after[-1], before[begin] = -1, -1, -1
        rank = np.full(n, NONE)
        inner = np.flatnonzero(after >= 0)
        rank[inner] = self.ranks(symbol[inner], symbol[inner + 1])
        positions: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def add(at: np.ndarray) -> None:
            at = at[rank[at] < NONE]
            if not len(at):
                return
            at = at[np.argsort(rank[at], kind="stable")]
            own = rank[at]
            cuts = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), len(at)]
            for i, r in enumerate(own[cuts[:-1]].tolist()):
                part = at[cuts[i]: cuts[i + 1]]
                if r in positions:
                    positions[r].append(part)
                else:
                    positions[r] = [part]
                    heapq.heappush(active, r)

        add(inner)
        while active:
            r = heapq.heappop(active)
            lists = positions.pop(r)
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            at = at[rank[at] == r]  # others have been merged or have got another neighbour since
            if not len(at):
                continue
            if self.left[r] == self.right[r]:
                at = _without_overlaps(np.sort(at), after)
            gone = after[at]
            follower = after[gone]
            symbol[at], symbol[gone] = self.new[r], -1
            rank[gone], after[at] = NONE, follower
            has = follower >= 0
            before[follower[has]] = at[has]
            rank[at[~has]] = NONE
            front = before[at]
            changed = np.unique(np.concatenate([at[has], front[front >= 0]]))
            rank[changed] = self.ranks(symbol[changed], symbol[after[changed]])
            add(changed)

    def encode_batch(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text, as the vocabulary's own library gives them, without added marks."""
        words, parts, group, held = Words(), [], [], 0
        plan: list[list[tuple[int, int]]] = []  # per text: (0, words of a segment) or (1, id of an added token)

        def flush() -> None:
            nonlocal group, held
            if group:
                index, counts = words.index(group)
                parts.append((index, counts.tolist()))
                group, held = [], 0

        for text in texts:
            steps: list[tuple[int, int]] = []
            split = self.added_at.split(text) if self.added_at and any(a in text for a in self.added) else [text]
            for k, segment in enumerate(split):
                if k % 2:
                    steps.append((1, self.added[segment]))
                elif segment:
                    for piece in pieces(segment):
                        group.append(piece)
                        steps.append((0, 0))
                        held += len(piece)
                        if held >= SPLIT_CHARS:
                            flush()
            plan.append(steps)
        flush()
        if len(words):
            ids, counts = self.encode_words(list(words.number))
            begin = np.cumsum(counts) - counts
        segments = self._segments(parts, ids, counts, begin) if len(words) else iter(())
        for steps in plan:
            found = [next(segments) if kind == 0 else np.array([i], np.uint32) for kind, i in steps]
            yield found[0] if len(found) == 1 else np.concatenate(found) if found else np.empty(0, np.uint32)

    @staticmethod
    def _segments(parts: list, ids: np.ndarray, counts: np.ndarray, begin: np.ndarray) -> Iterator[np.ndarray]:
        for i, (index, sizes) in enumerate(parts):
            parts[i] = None
            own = counts[index]
            ends = np.cumsum(own)
            flat = ids[np.arange(ends[-1]) + np.repeat(begin[index] - (ends - own), own)]
            at = done = 0
            for size in sizes:
                done += size
                end = int(ends[done - 1])
                yield flat[at:end]
                at = end

    def decode(self, ids: np.ndarray) -> str:
        table = self.bytes_of
        return b"".join([table[i] for i in ids.tolist()]).decode("utf-8", "replace")


def _without_overlaps(at: np.ndarray, after: np.ndarray) -> np.ndarray:
    """In a run of one symbol, every second pair from the left."""
    if not np.isin(after[at], at).any():
        return at
    taken, blocked = [], -1
    for p in at.tolist():
        if p != blocked:
            taken.append(p)
            blocked = int(after[p])
    return np.array(taken, at.dtype)


@lru_cache(2)
def encoder(content: bytes) -> PairIndexEncoder:
    return PairIndexEncoder(content)


def chunked(batches: Iterator[pa.RecordBatch], text_col: str, limit: int = CHUNK_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of record batches with their texts (null: empty), each of about ``limit`` characters at most."""
    for batch in batches:
        begin, size, texts = 0, 0, []
        column = batch.column(text_col)
        for i in range(batch.num_rows):
            text = column[i].as_py() or ""
            texts.append(text)
            size += len(text)
            if size >= limit or i + 1 == batch.num_rows:
                yield batch.slice(begin, i + 1 - begin), texts
                begin, size, texts = i + 1, 0, []


def encode(docs: DataFrame, *, text_col: str = "text", ids_col: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """``docs`` with ``ids_col``: the token ids as little-endian unsigned 32-bit integers.

    Null and empty text have no ids.  A text that holds the string of an added token gets that token's id.
    Other columns pass through; a column named ``ids_col`` is replaced.  Repeated rows stay repeated.
    """
    docs = docs.drop(ids_col)
    content = _shared(docs.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(content.value)
        for batch, texts in chunked(batches, text_col):
            ids = pa.array([x.astype("<u4").tobytes() for x in bpe.encode_batch(texts)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], [*batch.schema.names, ids_col])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(ids_col, T.BinaryType())]))


def decode(docs: DataFrame, *, ids_col: str = "ids", text_col: str = "decoded", vocabulary: str | None = None) -> DataFrame:
    """``docs`` with ``text_col``: the text of the ids, added tokens included; null ids give an empty text.

    Bytes that are no UTF-8 become U+FFFD.
    """
    docs = docs.drop(text_col)
    content = _shared(docs.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(content.value)
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                part = batch.slice(begin, 500)
                texts = [bpe.decode(np.frombuffer(x or b"", "<u4")) for x in part.column(ids_col).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())],
                                                 [*part.schema.names, text_col])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(text_col, T.StringType())]))


def _shared(spark: SparkSession, vocabulary: str | None):
    """The vocabulary file's content (a few MB, whatever the data), read on the driver."""
    with open(vocabulary or default_vocabulary(), "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text and the text they decode to, as digests."""
    ids = encode(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    return decode(ids).select(
        "doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


QUERIES = {"op5_bpe_round_trip": query}
