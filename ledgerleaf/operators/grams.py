"""Terms of many token rows at once, as arrays.

A row comes as its tokens laid out between blanks, `` a  b `` (``laid_out``); tokens are ASCII, so a character gram of up
to eight characters is one number.  Rows are taken ``CHUNK_BYTES`` at a time, so memory does not grow with the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerleaf.functions import text as tx

CHUNK_BYTES = 500_000
HELD_TERMS = 1_000_000      # counted terms that a task holds
BLANK = 32


def laid_out(toks: Column) -> Column:
    return F.concat(F.lit(" "), F.array_join(toks, "  "), F.lit(" "))


def chunks(laid: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """(first row, rows) of about ``CHUNK_BYTES``; a longer row is a chunk of its own."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(laid), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    begin = 0
    while begin < len(laid):
        before = upto[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(upto, before + CHUNK_BYTES, side="right")))
        yield begin, laid.slice(begin, end - begin)
        begin = end


def _names(raw: np.ndarray, prefix: str) -> pa.Array:
    """Strings of equal length from rows of bytes."""
    head = np.frombuffer(prefix.encode(), np.uint8)
    whole = np.hstack([np.broadcast_to(head, (len(raw), len(head))), raw])
    ends = np.arange(len(raw) + 1, dtype=np.int32) * whole.shape[1]
    return pa.StringArray.from_buffers(len(raw), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(whole)))


def _char_grams(data: np.ndarray, row: np.ndarray, lo: int, hi: int) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array]]:
    """Windows of ``lo`` to ``hi`` bytes of one row with blanks at their ends only."""
    shown = data != BLANK
    code = np.zeros(len(data), np.uint64)
    for n in range(1, hi + 1):
        m = len(data) - n + 1
        if m <= 0:
            return
        code = (code[:m] << np.uint64(8)) | data[n - 1:]
        if n < lo:
            continue
        inside = row[:m] == row[n - 1:]
        for i in range(1, n - 1):
            inside &= shown[i: i + m]
        if n <= 8:
            gram, found = pd.factorize(code[inside])
            raw = found.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - n:]
        else:
            windows = np.lib.stride_tricks.sliding_window_view(data, n)[inside]
            found, gram = np.unique(np.ascontiguousarray(windows).view(f"S{n}").ravel(), return_inverse=True)
            raw = found.view(np.uint8).reshape(-1, n)
        yield row[:m][inside], gram, _names(raw, tx.CHAR_PREFIX)


def _word_grams(data: np.ndarray, row: np.ndarray, lo: int, hi: int) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array]]:
    """Runs of ``lo`` to ``hi`` words of one row; a word has two characters at least."""
    shown = (data != BLANK).astype(np.int8)
    step = np.diff(shown, prepend=0, append=0)
    begin, end = np.flatnonzero(step > 0), np.flatnonzero(step < 0)
    ends = np.concatenate([[0], np.cumsum(end - begin)]).astype(np.int32)
    toks = pa.StringArray.from_buffers(len(begin), pa.py_buffer(ends), pa.py_buffer(data[shown > 0]))
    long = end - begin >= 2
    coded = toks.filter(pa.array(long)).dictionary_encode()
    words, word, row = coded.dictionary, coded.indices.to_numpy().astype(np.int64), row[begin[long]]
    gram, names = word, words
    for n in range(1, hi + 1):
        m = len(row) - n + 1
        if m <= 0:
            return
        if n > 1:
            gram, found = pd.factorize(gram[:m] * len(words) + word[n - 1:])
            names = pc.binary_join_element_wise(names.take(pa.array(found // len(words))), words.take(pa.array(found % len(words))), " ")
        if n >= lo:
            inside = row[:m] == row[n - 1:]
            yield row[:m][inside], gram[inside], pc.binary_join_element_wise(pa.scalar(tx.WORD_PREFIX), names, "")


def grams(laid: pa.Array, words: tuple[int, int] | None, chars: tuple[int, int] | None) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(row, number, names): every occurrence of a term, and the names by number; some names may not occur."""
    at = np.frombuffer(laid.buffers()[1], np.int32)[laid.offset: laid.offset + len(laid) + 1]
    held = laid.buffers()[2]
    data = np.frombuffer(held, np.uint8)[at[0]: at[-1]] if held is not None else np.zeros(0, np.uint8)
    row = np.repeat(np.arange(len(laid)), np.diff(at))
    parts = [*(_word_grams(data, row, *words) if words else ()), *(_char_grams(data, row, *chars) if chars else ())]
    if not parts:
        none = np.zeros(0, np.int64)
        return none, none, pa.array([], pa.string())
    first = np.cumsum([0, *(len(names) for *_, names in parts)])
    return (np.concatenate([r for r, *_ in parts]), np.concatenate([g + a for (_, g, _), a in zip(parts, first)]),
            pa.concat_arrays([names for *_, names in parts]))


def counted(row: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, number, times), by row and number, of occurrences whose numbers are below ``n``."""
    key, times = np.unique(row.astype(np.int64) * max(n, 1) + at, return_counts=True)
    return key // max(n, 1), key % max(n, 1), times


def _merged(held: list[pa.Table]) -> pa.Table:
    sums = pa.concat_tables(held).group_by("term", use_threads=False).aggregate([("df", "sum"), ("total", "sum")])
    return sums.select(["term", "df_sum", "total_sum"]).rename_columns(["term", "df", "total"])


def partial_counts(batches: Iterator[pa.RecordBatch], words: tuple[int, int] | None, chars: tuple[int, int] | None) -> Iterator[pa.RecordBatch]:
    """(term, df, total) of the rows of a task, a term more than once when there are many."""
    held, size = [], 0
    for batch in batches:
        for _, part in chunks(batch.column("laid")):
            row, gram, names = grams(part, words, chars)
            _, own, times = counted(row, gram, len(names))
            n_rows = np.bincount(own, minlength=len(names))
            total = np.bincount(own, times, len(names)).astype(np.int64)
            table = pa.table({"term": names, "df": n_rows.astype(np.int64), "total": total}).filter(pa.array(n_rows > 0))
            held, size = [*held, table], size + table.num_rows
            if size > HELD_TERMS:
                merged = _merged(held)
                held, size = [merged], merged.num_rows
                if size > HELD_TERMS // 2:
                    yield from merged.to_batches()
                    held, size = [], 0
    if held:
        yield from _merged(held).to_batches()
