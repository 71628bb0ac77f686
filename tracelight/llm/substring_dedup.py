"""Removal of passages that an earlier document has already (repeated-phrase automata).

Word windows that may recur meet in one task (see ``repeats``). There a window that more than one
document has is confirmed word by word and noted with the smallest id that has it. The confirmed
windows of the shard are compiled into an Aho-Corasick automaton over word numbers, and all text that
was sent to the shard is streamed through it to find every occurrence.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelight.llm import arrays as A
from tracelight.llm import repeats as R
from tracelight.llm.suffix_dedup import spans_of
from tracelight.llm.tables import gathered, keyed_and_unique

WINDOW_WORDS = 13
GRAM_WORDS = 4


def confirmed(pieces: list[tuple[int, ...]], least: np.ndarray, most: np.ndarray, sure: np.ndarray, width: int):
    """Windows (tuples of word numbers) that at least two ids have, and the smallest of them.

    ``least`` and ``most`` are the smallest and largest id of each piece; windows not in ``sure``
    (by piece and place) are known to stand in one piece only.
    """
    low: dict[tuple[int, ...], int] = {}
    high: dict[tuple[int, ...], int] = {}
    at = 0
    for words, small, large in zip(pieces, least.tolist(), most.tolist(), strict=True):
        n = len(words) - width + 1
        for place in range(n):
            if small != large or sure[at + place]:
                window = words[place : place + width]
                low[window] = min(small, low.get(window, small))
                high[window] = max(large, high.get(window, large))
        at += n
    return {w: small for w, small in low.items() if high[w] > small}


def automaton(windows: dict[tuple[int, ...], int]) -> ahocorasick.Automaton:
    built = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for window, smallest in windows.items():
        built.add_word(window, smallest)
    built.make_automaton()
    return built


def _judge(width: int):
    def run(batches):
        for table in R.whole_groups(batches):
            yield from _located(table, width)

    return run


def _located(table: pa.Table, width: int):
    p = R.pieces_of(table)
    data, ends = p.data, p.ends
    copy_of, one = R.distinct_pieces(data, ends[:-1], ends[1:], p.h, p.shape)
    text = copy_of[p.member]
    named = p.owner != R.NOBODY
    least = np.full(len(one), R.NOBODY)
    most = np.full(len(one), -R.NOBODY)
    np.minimum.at(least, text[named], p.owner[named])
    np.maximum.at(most, text[named], p.owner[named])
    known = least != R.NOBODY  # pieces of null ids neither remove nor are removed
    numbers: dict[bytes, int] = {}
    raw = data.tobytes()
    pieces = [
        tuple(numbers.setdefault(w, len(numbers)) for w in raw[ends[i] : ends[i + 1]].split()) if known[k] else ()
        for k, i in enumerate(one)
    ]
    count = np.array([max(0, len(p) - width + 1) for p in pieces], np.int64)
    base = np.append(0, np.cumsum(count))
    flat = np.fromiter((w for p in pieces for w in p), np.uint64, sum(map(len, pieces)))
    grams = A.PrefixHash(A.mixed(flat)).grams(width)
    begin = np.append(0, np.cumsum([len(p) for p in pieces]))[:-1]
    piece = np.repeat(np.arange(len(count)), count)
    window = grams[begin[piece] + np.arange(base[-1]) - base[piece]]
    _, inverse, times = np.unique(window, return_inverse=True, return_counts=True)
    phrases = confirmed(pieces, least, most, times[inverse] > 1, width)
    if not phrases:
        return
    find = automaton(phrases)
    smallest = np.full(base[-1], R.NOBODY)  # smallest id of each window of each piece
    for words, start in zip(pieces, base[:-1].tolist(), strict=True):
        if len(words) >= width:
            for end, small in find.iter(words):
                smallest[start + end - width + 1] = small
    # a row loses the windows that a smaller id has: rows of one piece may differ, so judge row by row
    found = np.bincount(piece[smallest != R.NOBODY], minlength=len(count)) > 0
    some = np.flatnonzero(found[text])
    row_at, row_window = gathered(base[text[some]], base[text[some] + 1])
    row = np.repeat(some, np.diff(row_at))
    lost = (smallest[row_window] < p.owner[row]) & named[row]
    yield from spans_of(lost, row_at, np.arange(len(some)), p.rid[some], p.first[some], width)


def _cut(window: int, with_text: bool):
    def run(batches):
        for block in A.blocks(batches):
            u = R.units(block.column("text"), words=True)
            row, first, last = R.span_arrays(block.column("spans"))
            n_words = np.diff(u.offsets)
            whole = block.column("copy").to_numpy(zero_copy_only=False).astype(bool) & (n_words >= window)
            gone = np.repeat(whole, n_words) | A.covered(len(u.starts), u.offsets[row] + first, u.offsets[row] + last)
            total = np.append(0, np.cumsum(gone))
            left = np.flatnonzero(~gone)
            begin, end = (np.searchsorted(left, x) for x in (u.offsets[:-1], u.offsets[1:]))
            at, picked = gathered(u.starts[left], u.ends[left] + 1)
            text = u.data[picked].tobytes()
            kept = [text[at[a] : max(at[a], at[b] - 1)] for a, b in zip(begin, end, strict=True)]
            columns = [
                block.column("owner"),
                pa.array(n_words),
                pa.array(total[u.offsets[1:]] - total[u.offsets[:-1]]),
                pa.array([hashlib.sha256(k).hexdigest() for k in kept]),
            ]
            names = ["owner", "n_words", "n_removed", "kept_sha256"]
            if with_text:
                columns.append(pa.array([k.decode() for k in kept]))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def remove_passages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW_WORDS, with_text: bool = False
) -> DataFrame:
    """Per document: words, words removed, SHA-256 of the words kept joined by one blank.

    A word is removed if it lies in ``window`` consecutive words that also start in a document of
    smaller id. ``with_text`` adds the words kept (``kept``).

    Null text has no words. Rows with equal ids do not remove each other's words; rows with a null id
    stay as they are and remove nothing. Extra columns of ``docs`` are not looked at. An empty table
    gives an empty result.
    """
    scheme = R.Scheme(words=True, width=window, gram=min(GRAM_WORDS, window))
    keyed, unique = keyed_and_unique(docs, id_col, text_col)
    rows = _with_copies(keyed) if unique else keyed.withColumn("copy", F.lit(False))
    own = rows.withColumn("text", F.when(~F.col("copy"), F.col("text")))
    spans = R.repeated_spans(own, scheme, _judge(window))
    schema = "owner long, n_words long, n_removed long, kept_sha256 string"
    cut = R.with_spans(rows, spans).mapInArrow(_cut(window, with_text), schema + (", kept string" if with_text else ""))
    return cut.withColumnRenamed("owner", id_col)


def _with_copies(keyed: DataFrame) -> DataFrame:
    """``keyed`` with ``copy``: whether a smaller id has the very same text.

    All windows of such a row recur, and none of them is needed to judge others.
    """
    first = keyed.groupBy(F.sha2("text", 256)).agg(F.min("rid").alias("rid")).select("rid", F.lit(False).alias("other"))
    return keyed.join(first, "rid", "left").select("rid", "owner", "text", F.coalesce("other", F.lit(True)).alias("copy"))
