"""Words and word shingles of many texts at once, on their bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import flat, mix

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
U = np.uint64


def tokens(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end and text of each word: a longest run of bytes other than blank, tab to carriage return."""
    inside = ~_SPACE[buf]
    ends_text = np.zeros(len(buf) + 1, bool)
    ends_text[off] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | ends_text[1:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | ends_text[1:-1]
    first, last = np.flatnonzero(start), np.flatnonzero(end) + 1
    return first, last, np.searchsorted(off, first, "right") - 1


def word_hashes(buf: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A hash of each word's bytes: its groups of eight bytes, each mixed with its place in the word, are added up.

    Mixing isn't linear in the bytes, so words that a polynomial can't tell apart (such as long Thue-Morse words) differ here.
    """
    if not len(first):
        return np.zeros(0, U)
    size = last - first
    groups = (size + 7) // 8
    begin = np.cumsum(groups) - groups
    place = np.arange(int(groups.sum())) - np.repeat(begin, groups)
    eight = np.ndarray((len(buf),), "<u8", np.concatenate([buf, np.zeros(8, np.uint8)]), strides=(1,))  # at every byte
    left = np.repeat(size, groups) - 8 * place
    value = eight[np.repeat(first, groups) + 8 * place] & (~U(0) >> (U(8) * (8 - np.minimum(left, 8)).astype(U)))
    mixed = mix(mix(value + U(0x2545F4914F6CDD1D)) + mix(place.astype(U) + U(11)))
    return mix(np.add.reduceat(mixed, begin) + size.astype(U))


def shingles(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, hash and count of each different shingle: `size` words in a row of the lower-cased text, or all words of a
    shorter one; sorted by text and hash."""
    buf, off = flat(pc.utf8_lower(texts))
    first, last, of = tokens(buf, off)
    words = word_hashes(buf, first, last)
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, np.int64)
    begin, end = np.searchsorted(of, np.arange(len(off) - 1), "left"), np.searchsorted(of, np.arange(len(off) - 1), "right")
    h = np.zeros(len(words), U)
    for k in range(size):
        there = np.arange(len(words)) + k < end[of]  # a short text has one shingle, of the words that it has
        h[there] = h[there] * U(0x9E3779B97F4A7C15) + mix(words[np.flatnonzero(there) + k] + U(k + 1))
    whole = (np.arange(len(words)) + size <= end[of]) | (np.arange(len(words)) == begin[of])
    h, of = mix(h[whole]), of[whole]
    order = np.lexsort([h, of])
    h, of = h[order], of[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (of[1:] != of[:-1])])
    at = np.flatnonzero(new)
    return of[at], h[at], np.diff(np.append(at, len(h)))


def in_pieces(batch: pa.RecordBatch, column: str = "text", most: int = 1_000_000):
    """The batch in slices with about so many bytes of text, or of one row."""
    sizes = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, at = np.cumsum(sizes), 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(at, to - at)
        at = to
