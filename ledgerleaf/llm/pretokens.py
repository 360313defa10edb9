"""Splitting texts into the words of a byte-level vocabulary, array at a time.

The pattern is ``'s|'t|'re|'ve|'m|'ll|'d| ?L+| ?N+| ?[^ white space, L, N]+|S+(?!\\S)|S+`` with L letters,
N numbers and S white space.  Its matches are runs of one class; what remains is where a run of white
space ends and which apostrophes begin a contraction, and both can be read off neighbouring characters.
So a batch of texts is cut with a few array operations instead of a match at a time.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
#: The characters with the property White_Space.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
PIECE_CHARS = 2_000_000
#: Between these two characters a word always ends.
SAFE_CUT = re.compile(r"[a-z](?= [a-z])")


@lru_cache(1)
def class_table() -> np.ndarray:
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(i))[0], OTHER) for i in range(0x110000)), np.uint8, 0x110000)
    table[WHITE_SPACE] = SPACE
    return table


def word_starts(points: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Where words begin in the joined code points of several non-empty texts."""
    n = len(points)
    kind = class_table()[points]
    first = np.zeros(n, bool)
    first[text_starts] = True
    starts = first.copy()
    starts[1:] |= kind[1:] != kind[:-1]
    space = kind == SPACE
    # the last white space before something else: a word of its own, or the beginning of the next word
    last = np.flatnonzero(space[:-1] & ~space[1:] & ~first[1:])
    starts[last] = True
    starts[last[points[last] == 0x20] + 1] = False
    marks = np.flatnonzero((points == 0x27) & starts)
    if len(marks):
        at = lambda i: np.where(i < n, points[np.minimum(i, n - 1)], 0)
        inside = lambda i: (i < n) & ~first[np.minimum(i, n - 1)]
        a, b = at(marks + 1), at(marks + 2)
        short = inside(marks + 1) & np.isin(a, [ord(c) for c in "stmd"])
        pairs = np.zeros(len(marks), bool)
        for x, y in ("re", "ve", "ll"):
            pairs |= (a == ord(x)) & (b == ord(y))
        long = inside(marks + 1) & inside(marks + 2) & pairs
        for chosen, length in ((short, 2), (long, 3)):
            p = marks[chosen]
            for k in range(1, length):
                starts[p + k] = False
            ends = p + length
            starts[ends[ends < n]] = True
    return np.flatnonzero(starts)


def pieces(text: str, limit: int = PIECE_CHARS) -> list[str]:
    """A long text in parts that can be split into words apart from each other."""
    out, begin = [], 0
    while len(text) - begin > limit:
        cut = SAFE_CUT.search(text, begin + limit)
        if not cut:
            break
        out.append(text[begin: cut.end()])
        begin = cut.end()
    return [*out, text[begin:]]


class Words:
    """Numbers distinct words in the order they appear; ``index`` maps texts to word numbers."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {}

    def __len__(self) -> int:
        return len(self.number)

    def index(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of all texts (none empty) in a row, and how many words each text has."""
        joined = "".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        begin = np.cumsum([0, *map(len, texts)])[:-1]
        starts = word_starts(points, begin)
        lengths = np.diff(starts, append=len(points))
        offset = np.arange(len(points)) - np.repeat(starts, lengths)
        weights = _weights(int(lengths.max()))
        codes, _ = pd.factorize(np.add.reduceat(weights[offset] * (points.astype(np.uint64) + np.uint64(1)), starts))
        model = np.empty(codes.max() + 1, np.int64)
        model[codes[::-1]] = np.arange(len(codes))[::-1]
        same = (lengths[model[codes]] == lengths).all() and \
            np.array_equal(points[np.repeat(starts[model[codes]], lengths) + offset], points)
        if not same:  # two words with one hash
            own = [joined[s: s + k] for s, k in zip(starts.tolist(), lengths.tolist(), strict=True)]
            codes, own = pd.factorize(np.array(own, object))
        else:
            own = [joined[s: s + k] for s, k in zip(starts[model].tolist(), lengths[model].tolist(), strict=True)]
        put, number = self.number.setdefault, self.number
        known = np.fromiter((put(w, len(number)) for w in own), np.int32, len(own))
        return known[codes], np.diff(np.searchsorted(starts, [*begin, len(points)]))


@lru_cache(8)
def _weights_of(size: int) -> np.ndarray:
    return np.random.default_rng(20_240).integers(1, 2**64, size, np.uint64) | np.uint64(1)


def _weights(longest: int) -> np.ndarray:
    return _weights_of(1 << max(8, longest.bit_length()))
