"""Texts of one Arrow batch as numpy arrays: bytes, words, rolling hashes, window anchors.

Everything here is a small helper that runs inside a Spark task on one block of documents. A block
is a run of whole documents of about ``BLOCK_BYTES``; a longer document is a block of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 2_000_000
#: Text at once where every document stands for itself and a larger block gains nothing.
SMALL_BLOCK_BYTES = 500_000
U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}

#: Bytes that end a word when words are runs of anything but blanks.
BLANKS = np.zeros(256, bool)
BLANKS[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of a word when words are lower-case letters, digits and everything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
#: Lower case of A-Z, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one byte array, and the n + 1 places where they begin and end; null is empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(at):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def blocks(batches, column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of the batches again, in runs of about ``limit`` bytes of text."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends, first = np.cumsum(sizes.astype(np.int64)), 0
        while first < len(sizes):
            before = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(first, last - first)
            first = last


def powers(n: int, base: int) -> np.ndarray:
    """1, base, base**2, ... modulo 2**64; at least n of them."""
    kept = _POWERS.get(base)
    if kept is None or len(kept) < n:
        grown = np.full(max(n, 1 << 16), base, U64)
        grown[0] = 1
        kept = _POWERS[base] = np.cumprod(grown, dtype=U64)
        if n > 1 << 23:
            _POWERS.pop(base)
    return kept


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of each value over the whole word, one to one."""
    x = x ^ (x >> U64(31))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    return x ^ (x >> U64(30))


class PrefixHash:
    """Polynomial hashes of all prefixes of a sequence; any stretch is hashed from two of them."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.prefix = np.zeros(n + 1, U64)
        np.cumsum((values.astype(U64) + U64(1)) * powers(n, _BASE)[:n], out=self.prefix[1:])
        self.inverse = powers(n + 1, _BASE_INVERSE)

    def raw(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.prefix[end] - self.prefix[start]) * self.inverse[start]

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed(self.raw(start, end))

    def grams(self, k: int) -> np.ndarray:
        """Hash of the k values from each position on that has as many."""
        n = len(self.prefix) - k
        if n <= 0:
            return np.zeros(0, U64)
        return mixed((self.prefix[k:] - self.prefix[:n]) * self.inverse[:n])


def word_bounds(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the number of words before each document (n + 1 values).

    ``inside`` says for each byte of ``data`` whether it belongs to a word. Words end with their document.
    """
    n = len(data)
    start, end = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
    start[:n], end[1:] = inside, inside
    start[1:n] &= ~inside[:-1]
    end[1:n] &= ~inside[1:]
    edge = offsets[(offsets > 0) & (offsets < n)]
    start[edge] = inside[edge]
    end[edge] = inside[edge - 1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end)
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return PrefixHash(data).of(starts, ends)


def owners(offsets: np.ndarray) -> np.ndarray:
    """For each unit, the document it is in."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def whole_windows(offsets: np.ndarray, width: int) -> np.ndarray:
    """Starts of all windows of ``width`` units that lie within one document."""
    n = int(offsets[-1])
    ok = np.ones(n, bool)
    for shift in offsets[1:]:  # the last width - 1 units of a document start none
        ok[max(0, shift - width + 1) : shift] = False
    return np.flatnonzero(ok)


def anchors(grams: np.ndarray, offsets: np.ndarray, width: int, k: int):
    """One anchor for each window of ``width`` units: its k-gram of least hash, the first of equal ones.

    Equal windows have their anchor at the same place, so equal windows meet at equal k-grams.
    Returns document, anchor position and the first and last window start of each anchor, positions
    counted from the start of the block. The windows of an anchor are neighbours.
    """
    span = width - k + 1
    n = len(grams)
    empty = np.zeros(0, np.int64)
    if n < span:
        return empty, empty, empty, empty
    # the order of the whole hashes, then the place: equal windows choose alike in every block
    order = np.unique(grams, return_inverse=True)[1].astype(U64)
    bits = U64(max(1, int(n).bit_length()))
    least = (order << bits) | np.arange(n, dtype=U64)
    size = 1
    while 2 * size <= span:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < span:
        least = np.minimum(least[: len(least) - (span - size)], least[span - size :])
    first = whole_windows(offsets, width)
    if not len(first):
        return empty, empty, empty, empty
    at = (least[first] & ((U64(1) << bits) - U64(1))).astype(np.int64)
    new = np.ones(len(first), bool)
    new[1:] = (at[1:] != at[:-1]) | (np.diff(first) != 1)
    begins = np.flatnonzero(new)
    lasts = np.append(begins[1:], len(first)) - 1
    doc = np.searchsorted(offsets, first[begins], side="right") - 1
    return doc, at[begins], first[begins], first[lasts]


def covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n units lie in one of the stretches [start, end)."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, ends, -1)
    return np.cumsum(change[:n]) > 0
