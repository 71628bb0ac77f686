"""Removal of long byte strings that occur more than once (suffix-array dedup).

Suffixes that can share a long prefix meet in one task (see ``repeats``). There they are sorted by
mergesort. Two suffixes are compared by their longest common extension, which a binary search over
prefix polynomial hashes finds in logarithmically many steps; the byte after it decides. Neighbours
of the sorted order whose extension reaches the length sought are equal strings; the bytes of each
such pair are compared before it counts, so a hash collision cannot remove anything.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tracelight.llm import arrays as A
from tracelight.llm import repeats as R
from tracelight.llm.tables import gathered, row_keyed

MIN_BYTES = 200
GRAM_BYTES = 50


class Suffixes:
    """Suffixes of a byte buffer, compared on their first ``width`` bytes."""

    def __init__(self, data: np.ndarray, width: int):
        self.data, self.width = data, width
        self.hashes = A.PrefixHash(data)

    def extension(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of the suffixes at x and y, at most ``width``."""
        low, high = np.zeros(len(x), np.int64), np.full(len(x), self.width)
        while (open_ := low < high).any():
            middle = (low + high + 1) // 2
            same = self.hashes.raw(x, x + middle) == self.hashes.raw(y, y + middle)
            low = np.where(same & open_, middle, low)
            high = np.where(same | ~open_, high, middle - 1)
        return low

    def order_of(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """-1, 0 or 1: the suffix at x sorts before, equals or sorts after the one at y."""
        common = self.extension(x, y)
        at = np.minimum(common, self.width - 1)
        return np.where(common == self.width, 0, np.sign(self.data[x + at].astype(np.int16) - self.data[y + at]))

    def sort(self, at: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mergesort of the suffixes within each group; returns the order and the group of each.

        All runs of one length are merged together: each suffix finds its rank in the run beside
        its own by binary search.
        """
        order = np.argsort(group, kind="stable")
        group = group[order]
        begin = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.zeros(0, np.int64)
        size = np.diff(np.append(begin, len(group)))
        first, length = np.repeat(begin, size), np.repeat(size, size)
        place = np.arange(len(group)) - first
        run = 1
        while (live := np.flatnonzero(length > run)).size:
            own = place[live] // run
            other = (own ^ 1) * run
            low = np.minimum(other, length[live])
            end = np.minimum(other + run, length[live])
            mine, shift, left_first = at[order[live]], first[live], own & 1
            start = low.copy()
            while (open_ := np.flatnonzero(low < end)).size:
                middle = (low[open_] + end[open_]) // 2
                rival = at[order[shift[open_] + middle]]
                # a rival goes before me if it is smaller, or equal and from the left run
                counts = self.order_of(rival, mine[open_]) < left_first[open_]
                low[open_] = np.where(counts, middle + 1, low[open_])
                end[open_] = np.where(counts, end[open_], middle)
            target = shift + (own & ~1) * run + (place[live] - own * run) + (low - start)
            order[target] = order[live].copy()
            run *= 2
        return order, group


def _judge(width: int):
    def run(batches):
        for table in R.whole_groups(batches):
            p = R.pieces_of(table)
            copy_of, one = R.distinct_pieces(p.data, p.ends[:-1], p.ends[1:], p.h, p.shape)
            before, count = R.before_of(p.shape[one]), R.more_of(p.shape[one]) + 1
            dup, base = _repeated_windows(p.data, p.ends[one], p.h[one], before, count, width)
            text = copy_of[p.member]
            dup |= np.repeat(np.bincount(text, minlength=len(one)) > 1, count)
            yield from spans_of(dup, base, text, p.rid, p.first, width)

    return run


def _repeated_windows(data, begin, h, before, count, width) -> tuple[np.ndarray, np.ndarray]:
    """For each window of each distinct piece, whether another piece of its anchor has it too.

    Returns the flags and where those of each piece begin. ``before`` is the number of bytes before
    the anchor, ``count`` the number of windows.
    """
    base = np.append(0, np.cumsum(count))
    piece = np.repeat(np.arange(len(count)), count)
    place = np.arange(base[-1]) - base[piece]
    dup = np.zeros(base[-1], bool)
    _, group, members = np.unique(h, return_inverse=True, return_counts=True)
    shared = np.flatnonzero(members[group][piece] > 1)
    if not len(shared):
        return dup, base
    at = begin[piece[shared]] + place[shared]
    offset = before[piece[shared]] - place[shared]  # of the anchor in the window
    suffixes = Suffixes(data, width)
    order, key = suffixes.sort(at, group[piece[shared]] * (width + 1) + offset)
    x, y = at[order[:-1]], at[order[1:]]
    pair = np.flatnonzero(key[1:] == key[:-1])
    pair = pair[suffixes.extension(x[pair], y[pair]) == width]
    pair = pair[R.same_bytes(data, x[pair], y[pair], np.full(len(pair), width))]
    dup[shared[order[pair]]] = dup[shared[order[pair + 1]]] = True
    return dup, base


def spans_of(dup, base, copy_of, rid, first, width):
    """Stretches of units covered by marked windows, for every row that has a piece."""
    piece = np.repeat(np.arange(len(base) - 1), np.diff(base))
    place = np.arange(base[-1]) - base[piece]
    marked = np.flatnonzero(dup)
    new = np.ones(len(marked), bool)
    new[1:] = (np.diff(marked) != 1) | (np.diff(piece[marked]) != 0)
    begins = np.flatnonzero(new)
    from_, to = marked[begins], marked[np.append(begins[1:], len(marked)) - 1] if len(marked) else marked
    runs = np.append(0, np.cumsum(np.bincount(piece[from_], minlength=len(base) - 1)))
    at, run = gathered(runs[copy_of], runs[copy_of + 1])
    row = np.repeat(np.arange(len(rid)), np.diff(at))
    for i in range(0, len(row), 100_000):
        r, s = row[i : i + 100_000], run[i : i + 100_000]
        yield pa.RecordBatch.from_arrays(
            [pa.array(rid[r]), pa.array(first[r] + place[from_[s]]), pa.array(first[r] + place[to[s]] + width)],
            names=["rid", "first", "last"],
        )


def _cut(keep_text: bool):
    def run(batches):
        for block in A.blocks(batches):
            data, ends = A.utf8(block.column("text"))
            row, first, last = R.span_arrays(block.column("spans"))
            gone = A.covered(len(data), ends[row] + first, ends[row] + last)
            begins = gone.copy()
            begins[1:] &= ~gone[:-1]
            edge = ends[:-1][ends[:-1] < len(data)]
            begins[edge] = gone[edge]
            total = np.append(0, np.cumsum(gone))
            spans = np.append(0, np.cumsum(begins))
            kept = [data[a:b][~gone[a:b]].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
            columns = [
                block.column("rid"),
                pa.array(np.diff(ends)),
                pa.array(total[ends[1:]] - total[ends[:-1]]),
                pa.array(spans[ends[1:]] - spans[ends[:-1]]),
                pa.array([hashlib.sha256(k).hexdigest() for k in kept]),
            ]
            names = ["rid", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if keep_text:
                columns.append(pa.array(kept, pa.binary()))
                names.append("kept")
            columns.insert(1, block.column("owner"))
            names.insert(1, "owner")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_bytes: int = MIN_BYTES, with_bytes: bool = False
) -> DataFrame:
    """Per document: bytes, bytes removed, removed runs, SHA-256 of what is left.

    A byte is removed if it lies in a string of ``min_bytes`` bytes that starts anywhere else too, in
    this document or another. ``with_bytes`` adds the bytes left (``kept``; cutting may split a character).

    Null text is empty. Rows with equal or null ids are documents of their own. Extra columns of
    ``docs`` are not looked at. An empty table gives an empty result.
    """
    scheme = R.Scheme(words=False, width=min_bytes, gram=max(1, min_bytes // 4))
    keyed = row_keyed(docs, id_col, text_col)
    spans = R.repeated_spans(keyed, scheme, _judge(min_bytes))
    schema = "rid long, owner long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    cut = R.with_spans(keyed, spans).mapInArrow(_cut(with_bytes), schema + (", kept binary" if with_bytes else ""))
    return cut.withColumnRenamed("owner", id_col).drop("rid")
