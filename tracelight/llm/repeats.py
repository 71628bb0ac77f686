"""Stretches that occur more than once in a corpus: routing them to the task that can compare them.

A window is ``width`` consecutive units (bytes or words) of one document. Each window has one anchor,
the k-gram of least hash in it; equal windows have equal anchors at the same place. So

1. every document gives its anchors, about 2 / (width - k + 2) of its units, with the windows they serve;
2. anchors meet by hash; one that nobody else has proves its windows unique, and is gone;
3. for those left, the text around the anchor (all its windows, at most 2 * width units) is fetched
   from the document and sent to the task of that hash;
4. that task compares whole groups (``judge``) and returns stretches of the documents.

Nothing is lost in steps 1-3, they only leave out windows that have no equal.

A few anchors may belong to a large share of all documents. Each block of documents (about 2 MB)
therefore works ahead: an anchor it has twice needs no other to be known as recurring, so only one of
its rows goes to the task of that hash and the others are dealt over many; and equal pieces of a block
travel once, with the list of rows that have them.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelight.llm import arrays as A
from tracelight.llm.tables import gathered, slices


#: Stands for a null owner.
NOBODY = np.iinfo(np.int64).max


class Scheme(NamedTuple):
    """What is compared: runs of ``width`` bytes or words, anchored at their least ``gram``-gram."""

    words: bool
    width: int
    gram: int


class Units(NamedTuple):
    data: np.ndarray  # bytes; words are followed by one blank each
    offsets: np.ndarray  # units before each document
    starts: np.ndarray  # of each unit in data
    ends: np.ndarray
    values: np.ndarray


def units(texts: pa.Array, words: bool) -> Units:
    data, offsets = A.utf8(texts)
    if not words:
        at = np.arange(len(data) + 1)
        return Units(data, offsets, at[:-1], at[1:], data)
    starts, ends, offsets = A.word_bounds(data, offsets, ~A.BLANKS[data])
    values = A.word_hashes(data, starts, ends)
    at, picked = gathered(starts, ends)
    shift = np.arange(len(starts))
    spaced = np.full(at[-1] + len(starts), 0x20, np.uint8)
    spaced[np.arange(at[-1]) + np.repeat(shift, np.diff(at))] = data[picked]
    return Units(spaced, offsets, at[:-1] + shift, at[1:] + shift, values)


def shaped(before, more):
    """Units before the anchor and windows after the first as one number; each may be up to 2**31."""
    return (before << 31) | more


def before_of(shape):
    return shape >> 31


def more_of(shape):
    return shape & ((1 << 31) - 1)


_KNOWN = 1 << 62  # in ``at``: the block has this anchor more than once
_DEALT = 1021
_ANCHORS = "h long, rid long, at long, shape long"  # at: the first window
_PIECES = "h long, shape long, who binary, piece binary"
SPANS = "rid long, first long, last long"


class Pieces(NamedTuple):
    """Pieces of whole groups, and the rows that have them."""

    h: np.ndarray
    shape: np.ndarray  # place of the anchor in the first window, and windows after it
    data: np.ndarray
    ends: np.ndarray
    member: np.ndarray  # piece of each row
    rid: np.ndarray
    owner: np.ndarray
    first: np.ndarray


def bytes_of(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all values laid end to end, and where each begins and ends."""
    data, sizes = [np.zeros(0, np.uint8)], [np.zeros(0, np.int64)]
    for c in (c.cast(pa.large_binary()) for c in column.chunks):
        at = np.frombuffer(c.buffers()[1], np.int64)[c.offset : c.offset + len(c) + 1]
        data.append(np.frombuffer(c.buffers()[2], np.uint8)[at[0] : at[-1]])
        sizes.append(np.diff(at))
    return np.concatenate(data), np.append(0, np.cumsum(np.concatenate(sizes)))


def pieces_of(table: pa.Table) -> Pieces:
    data, ends = bytes_of(table.column("piece"))
    who, who_ends = bytes_of(table.column("who"))
    rid, owner, first = who.view(np.int64).reshape(-1, 3).T
    member = np.repeat(np.arange(len(table)), np.diff(who_ends) // 24)
    return Pieces(table.column("h").to_numpy(), table.column("shape").to_numpy(), data, ends, member, rid, owner, first)


def same_bytes(data: np.ndarray, x: np.ndarray, y: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the ``size`` bytes from x and from y on agree, one by one."""
    same = np.ones(len(x), bool)
    step = max(1, 8_000_000 // max(1, int(size.max(initial=1))))
    for i in range(0, len(x), step):
        n = size[i : i + step]
        at, left = gathered(x[i : i + step], x[i : i + step] + n)
        _, right = gathered(y[i : i + step], y[i : i + step] + n)
        wrong = np.append(0, np.cumsum(data[left] != data[right]))
        same[i : i + step] = wrong[at[1:]] == wrong[at[:-1]]
    return same


def distinct_pieces(data, starts, ends, h, shape) -> tuple[np.ndarray, np.ndarray]:
    """For each piece the number of its distinct text, and a piece that has it.

    Pieces are the same if anchor, place of the anchor and bytes agree; the bytes are compared.
    """
    looks = A.PrefixHash(data).of(starts, ends) ^ A.mixed(shape.view(np.uint64))
    order = np.lexsort((looks, h))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (looks[order][1:] != looks[order][:-1])
    one = order[new]
    copy_of = np.empty(len(h), np.int64)
    copy_of[order] = np.cumsum(new) - 1
    rep, size = one[copy_of], ends - starts
    short = np.minimum(size, size[rep])
    odd = np.flatnonzero((size != size[rep]) | (shape != shape[rep]) | ~same_bytes(data, starts, starts[rep], short))
    copy_of[odd] = len(one) + np.arange(len(odd))  # equal hashes, other bytes: texts of their own
    return copy_of, np.append(one, odd)


def _anchor_rows(scheme: Scheme):
    def run(batches):
        for block in A.blocks(batches):
            u = units(block.column("text"), scheme.words)
            grams = A.PrefixHash(u.values).grams(scheme.gram)
            doc, anchor, first, last = A.anchors(grams, u.offsets, scheme.width, scheme.gram)
            start = u.offsets[doc]
            h, rid = grams[anchor], block.column("rid").to_numpy()[doc]
            _, one, same, times = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
            known = times[same] > 1
            salt = np.where(known, 1 + rid % _DEALT, 0)
            salt[one] = 0
            at = (first - start) | np.where(known, _KNOWN, 0)
            columns = [h.view(np.int64), rid, at, shaped(anchor - first, last - first), salt]
            yield _batch(columns, ["h", "rid", "at", "shape", "salt"])

    return run


def whole_groups(batches, column: str = "h", limit: int = 2_500_000):
    """Batches sorted by ``column`` again, cut between groups, in tables of about ``limit`` bytes."""
    kept: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        if size >= limit:
            key = batch.column(column).to_numpy()
            last = kept[-1].column(column)[-1].as_py()
            cut = int(np.searchsorted(key != last, True)) if key[0] == last else 0
            cut = len(key) if key[-1] == last else cut
            kept.append(batch.slice(0, cut))
            if cut < len(key):
                yield pa.Table.from_batches([b for b in kept if b.num_rows])
                kept, size = [], 0
            batch = batch.slice(cut)
        if batch.num_rows:
            kept.append(batch)
            size += batch.nbytes
    if kept:
        yield pa.Table.from_batches(kept)


def _recurring(batches):
    """Anchors that have an equal one, known from their block or as a neighbour: the rows are sorted by hash."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        names = ["h", "rid", "at", "shape"]
        h, rid, at, shape = (batch.column(c).to_numpy() for c in names)
        keep = (at & _KNOWN) != 0
        same = h[1:] == h[:-1]
        keep[1:] |= same
        keep[:-1] |= same
        rows = [h, rid, at & ~_KNOWN, shape]
        if held is not None and held[0][0] == h[0]:
            keep[0] = True
            if not held[4]:
                yield _batch(list(held[:4]), names)
        yield _batch([c[keep] for c in rows], names)
        held = (*[c[-1:] for c in rows], keep[-1])


def _batch(columns: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names)


def _pieces(scheme: Scheme):
    """The text around each requested anchor, all its windows; equal pieces of a block once."""

    def run(batches):
        for block in A.blocks(batches):
            asked = block.column("asked")
            counts = np.diff(asked.offsets.to_numpy())
            if not counts.sum():
                continue
            inner = asked.flatten()
            h, first, shape = (inner.field(c).to_numpy() for c in ("h", "at", "shape"))
            doc = np.repeat(np.arange(block.num_rows), counts)
            u = units(block.column("text"), scheme.words)
            start = u.offsets[doc]
            begin, end = u.starts[first + start], u.ends[first + more_of(shape) + start + scheme.width - 1]
            copy_of, one = distinct_pieces(u.data, begin, end, h, shape)
            owner = block.column("owner").fill_null(NOBODY).to_numpy()
            order = np.argsort(copy_of, kind="stable")
            who = np.stack([block.column("rid").to_numpy()[doc], owner[doc], first], axis=1)[order].reshape(-1)
            ends = np.cumsum(np.bincount(copy_of, minlength=len(one))) * 24
            lists = slices(who.astype(np.int64).view(np.uint8), np.append(0, ends[:-1]), ends)
            texts = slices(u.data, begin[one], end[one])
            for i in range(0, len(one), 20_000):
                some = slice(i, i + 20_000)
                columns = [h[one][some], shape[one][some], lists[some], texts[some]]
                yield _batch(columns, ["h", "shape", "who", "piece"])

    return run


def repeated_spans(keyed: DataFrame, scheme: Scheme, judge: Callable) -> DataFrame:
    """Stretches [first, last) of units of the rows of ``keyed`` that ``judge`` returns.

    ``keyed`` is the result of ``row_keyed``. ``judge`` gets an iterator of Arrow batches
    (h, shape, who, piece) sorted by h, with whole groups of h in one task; see ``pieces_of``.
    """
    anchors = keyed.select("rid", "owner", "text").mapInArrow(_anchor_rows(scheme), f"{_ANCHORS}, salt long")
    dealt = anchors.repartition("h", "salt").drop("salt").sortWithinPartitions("h")
    met = dealt.mapInArrow(_recurring, _ANCHORS)
    asked = met.groupBy("rid").agg(F.collect_list(F.struct("h", "at", "shape")).alias("asked"))
    empty = F.array().cast("array<struct<h:bigint,at:bigint,shape:bigint>>")
    pieces = (
        keyed.join(asked, "rid", "left")
        .select("rid", "owner", "text", F.coalesce("asked", empty).alias("asked"))
        .mapInArrow(_pieces(scheme), _PIECES)
    )
    return pieces.repartition("h").sortWithinPartitions("h").mapInArrow(judge, SPANS)


def with_spans(keyed: DataFrame, spans: DataFrame) -> DataFrame:
    """``keyed`` with the array ``spans`` of its stretches (empty if none)."""
    lists = spans.groupBy("rid").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    empty = F.array().cast("array<struct<first:bigint,last:bigint>>")
    return keyed.join(lists, "rid", "left").withColumn("spans", F.coalesce("spans", empty))


def span_arrays(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last of each stretch of an array column."""
    counts = np.diff(column.offsets.to_numpy())
    inner = column.flatten()
    return np.repeat(np.arange(len(column)), counts), inner.field("first").to_numpy(), inner.field("last").to_numpy()
