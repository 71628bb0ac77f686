"""Periodic runs of words: maximal pairs from a bottom-up walk over the LCP-interval tree.

A maximal pair is two equal stretches of a document that differ in the word before and in the word
after them. If their distance p is small against their length l, the two overlap, and together they
are a stretch of period p that no neighbouring word extends: a run, without any extension step. So the
runs are the maximal pairs with ``l + p >= max(MIN_LENGTH, MIN_PERIODS * p)``; a stretch that comes
with several distances has the least of them as its smallest period.

Suffixes are sorted by doubling exact ranks of words, so no hash decides anything. The intervals of
equal prefixes are walked bottom-up; each keeps its places in order and, per left word, a list of them.
When two children meet, every place of the smaller looks only for places of other left words within
the distance allowed. The places of one window are equally spaced and all but the first have the same
left word (they are occurrences of one string that overlap), so two lists are all that is looked at.

Before that, words that cannot be in a run are left out without loss: within a run of period q every
three words but the first q repeat at a distance of at most q, and there are at least
``(MIN_PERIODS - 1) * q - 2`` of them in a row.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelight.llm import arrays as A

MIN_LENGTH = 6
MIN_PERIODS = 4
_GRAM = 3
#: Shortest equal stretch of a run's pair; shorter common prefixes are not walked.
_LEAST = min(max(MIN_LENGTH - p, (MIN_PERIODS - 1) * p) for p in range(1, MIN_LENGTH))


def candidate_segments(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint stretches [first, last) of words, each within one document, that contain all runs whole."""
    n = len(hashes)
    empty = np.zeros(0, np.int64)
    if n < MIN_LENGTH:
        return empty, empty
    doc = A.owners(offsets)
    grams = A.PrefixHash(hashes).grams(_GRAM)
    places = np.flatnonzero(doc[: len(grams)] == doc[_GRAM - 1 : _GRAM - 1 + len(grams)])
    grams, home = grams[places], doc[places]
    order = np.lexsort((grams, home))
    same = (grams[order][1:] == grams[order][:-1]) & (home[order][1:] == home[order][:-1])
    back = np.full(n, n, np.int64)  # distance to the same three words before
    later, earlier = places[order[1:]], places[order[:-1]]
    back[later[same]] = (later - earlier)[same]
    change = np.zeros(n + 1, np.int64)
    begin, end = offsets[doc], offsets[doc + 1]
    low = 1
    while low * MIN_PERIODS <= int(np.diff(offsets).max(initial=0)):
        high = 2 * low - 1
        need = max((MIN_PERIODS - 1) * low - _GRAM + 1, MIN_LENGTH - high - _GRAM + 1, 1)
        near = np.zeros(n + 2, np.int8)
        near[1:-1] = back <= high
        edge = np.diff(near)
        first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        long = last - first >= need
        first, last = first[long], last[long]
        np.add.at(change, np.maximum(first - high, begin[first]), 1)
        np.add.at(change, np.minimum(last + _GRAM - 1, end[last - 1]), -1)
        low *= 2
    inside = np.cumsum(change[:n]) > 0
    cut = np.zeros(n + 1, bool)  # a stretch ends with its document
    cut[offsets] = True
    starts = np.flatnonzero(inside & (cut[:n] | ~np.append(False, inside[:-1])))
    ends = np.flatnonzero(inside & (cut[1:] | ~np.append(inside[1:], False))) + 1
    return starts, ends


def sorted_suffixes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of the values, and the common prefix of each suffix with the one before it (0 first)."""
    n = len(values)
    rank = np.unique(values, return_inverse=True)[1].astype(np.int64)
    levels = [rank.astype(np.int32)]
    width = 1
    while True:
        after = np.zeros(n, np.int64)
        after[: max(0, n - width)] = rank[width:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        new = np.append(False, key[order][1:] != key[order][:-1])
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        if new.sum() == n - 1:
            break
        levels.append(rank.astype(np.int32))
        width *= 2
    x, y = order[:-1].copy(), order[1:].copy()
    common = np.zeros(n, np.int64)
    for step in range(len(levels) - 1, -1, -1):
        size, level = 1 << step, levels[step]
        # equal ranks of one level are equal stretches; a suffix shorter than that is cut by the end of the values
        fits = (x + size <= n) & (y + size <= n)
        same = fits & (level[np.minimum(x, n - 1)] == level[np.minimum(y, n - 1)])
        common[1:] += np.where(same, size, 0)
        x, y = np.where(same, x + size, x), np.where(same, y + size, y)
    return order, common


class _Places:
    """Places of one interval: all of them in order, and those of each left word in order."""

    __slots__ = ("all", "by_left")

    def __init__(self, place: int, left: list[int]):
        self.all = [place]
        self.by_left = {left[place]: [place]}


def maximal_pairs(order: np.ndarray, common: np.ndarray, left: list[int]) -> list[tuple[int, int, int]]:
    """(place, distance, length) of the maximal pairs with length >= (MIN_PERIODS - 1) * distance."""
    found: list[tuple[int, int, int]] = []

    def joined(one, other, size: int):
        """One interval of the places of two children, whose equal prefix is ``size`` long."""
        reach = size // (MIN_PERIODS - 1)
        if isinstance(other, int):
            small, rest = (other,), None
            if isinstance(one, int):
                if abs(one - other) <= reach and left[one] != left[other]:
                    found.append((min(one, other), abs(one - other), size))
                one = _Places(one, left)
                rest = True
        elif isinstance(one, int):
            one, small, rest = other, (one,), None
        else:
            if len(one.all) < len(other.all):
                one, other = other, one
            small, rest = other.all, None
        places, by_left = one.all, one.by_left
        if rest is None:
            for place in small:
                low, high = place - reach, place + reach
                begin = bisect_left(places, low)
                if begin == len(places) or places[begin] > high:
                    continue
                end = bisect_right(places, high, begin)
                own = left[place]
                for kind in {left[places[begin]], left[places[end - 1]]}:
                    if kind != own:
                        mates = by_left[kind]
                        for mate in mates[bisect_left(mates, low) : bisect_right(mates, high)]:
                            found.append((min(place, mate), abs(place - mate), size))
        for place in small:
            insort(places, place)
            mates = by_left.get(left[place])
            if mates is None:
                by_left[left[place]] = [place]
            else:
                insort(mates, place)
        return one

    stack: list[list] = []
    now = None
    # suffixes without a neighbour of a long common prefix are in no pair
    near = np.flatnonzero((common >= _LEAST) | np.append(common[1:] >= _LEAST, False))
    for place, size in zip(order[near].tolist(), common[near].tolist(), strict=True):
        while stack and stack[-1][0] > size:
            length, places = stack.pop()
            now = joined(places, now, length)
        if size >= _LEAST:
            if stack and stack[-1][0] == size:
                stack[-1][1] = joined(stack[-1][1], now, size)
            else:
                stack.append([size, now])
        now = place
    while stack:
        length, places = stack.pop()
        now = joined(places, now, length)
    return found


def runs_of(values: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and smallest period of all runs, by start and period.

    ``left`` numbers the value before each place; the first places of stretches have numbers of their own.
    """
    if len(values) < MIN_LENGTH:
        return (np.zeros(0, np.int64),) * 3
    order, common = sorted_suffixes(values)
    pairs = np.array(maximal_pairs(order, common, left.tolist()), np.int64).reshape(-1, 3)
    start, period, length = pairs[:, 0], pairs[:, 1], pairs[:, 1] + pairs[:, 2]
    whole = length >= np.maximum(MIN_LENGTH, MIN_PERIODS * period)
    start, period, length = start[whole], period[whole], length[whole]
    by = np.lexsort((period, length, start))
    start, period, length = start[by], period[by], length[by]
    least = np.append(True, (np.diff(start) != 0) | (np.diff(length) != 0))[: len(start)]
    start, period, length = start[least], period[least], length[least]
    by = np.lexsort((period, start))
    return start[by], length[by], period[by]


def _block_runs(data, starts, ends, offsets):
    """Document, start (word of the block), length and period of the runs of a block of documents."""
    hashes = A.word_hashes(data, starts, ends)
    first, last = candidate_segments(hashes, offsets)
    empty = np.zeros(0, np.int64)
    if not len(first):
        return empty, empty, empty
    size = last - first
    word = np.repeat(first - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum())
    # words by their bytes; a value of its own stands after each stretch
    known: dict[bytes, int] = {}
    raw = data.tobytes()
    number = np.array([known.setdefault(raw[a:b], len(known)) for a, b in zip(starts[word].tolist(), ends[word].tolist(), strict=True)])
    stretch = np.repeat(np.arange(len(first)), size)
    at = np.arange(len(word)) + stretch
    values = np.empty(len(word) + len(first), np.int64)
    values[at] = number
    gap = np.cumsum(size) + np.arange(len(first))
    values[gap] = len(known) + np.arange(len(first))
    left = np.append(len(known) + len(first), values[:-1])
    start, length, period = runs_of(values, left)
    back = np.empty(len(values), np.int64)
    back[at] = word
    return back[start], length, period


_COLUMNS = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def _describe(with_output: bool):
    def run(batches):
        for block in A.blocks(batches):
            data, bytes_at = A.utf8(block.column("text"))
            starts, ends, offsets = A.word_bounds(data, bytes_at, ~A.BLANKS[data])
            start, length, period = _block_runs(data, starts, ends, offsets)
            gone = A.covered(len(starts), start + period, start + length)
            of = np.searchsorted(start, offsets)  # runs before each document
            raw, texts, lists, rows = data.tobytes(), [], [], []
            for i in range(block.num_rows):
                low, high = int(offsets[i]), int(offsets[i + 1])
                own = slice(int(of[i]), int(of[i + 1]))
                s, n, p = start[own] - low, length[own], period[own]
                if len(s):
                    top = np.lexsort((p, s, -n))[0]
                    best = [int(s[top]), int(n[top]), int(p[top]), 1000 * int(n[top]) // int(p[top])]
                else:
                    best = [None] * 4
                kept = np.flatnonzero(~gone[low:high]) + low
                text = b" ".join([raw[a:b] for a, b in zip(starts[kept].tolist(), ends[kept].tolist(), strict=True)])
                spelled = "".join(f"{a},{b},{c}\n" for a, b, c in zip(s.tolist(), n.tolist(), p.tolist(), strict=True))
                rows.append([len(s), *best, _sha(spelled.encode()), _sha(text)])
                if with_output:
                    texts.append(text.decode())
                    lists.append([{"start": a, "length": b, "period": c} for a, b, c in zip(s.tolist(), n.tolist(), p.tolist(), strict=True)])
            names = [c.split()[0] for c in _COLUMNS.split(", ")]
            kinds = [pa.string() if "string" in c else pa.int64() for c in _COLUMNS.split(", ")]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            if with_output:
                columns += [pa.array(texts, pa.string()), pa.array(lists, _RUN_LIST)]
                names += ["collapsed", "runs"]
            yield pa.RecordBatch.from_arrays([block.column("row"), *columns], names=["row", *names])

    return run


_RUN_LIST = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_output: bool = False) -> DataFrame:
    """Per row its id, number of runs, longest run and digests; one row for each row of ``docs``.

    A run is a stretch of consecutive words with smallest period q and at least
    ``max(MIN_LENGTH, MIN_PERIODS * q)`` words that no neighbouring word extends keeping that period. Of
    runs of greatest length the one of smallest start, then period, is told. ``with_output`` adds the
    text without the words after the first period of each run (``collapsed``) and the ``runs``.

    Null and blank texts have no words and no runs (nulls for the longest run, digests of the empty
    text). Ids of any type may be null or repeat: rows are judged each for itself. Other columns of
    ``docs`` are not looked at. An empty table gives an empty result. A document is searched in one
    task as a whole, at about 100 bytes of memory per word that may be in a run.
    """
    rows = docs.select(F.struct(F.col(f"`{id_col}`").alias("id")).alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    more = ", collapsed string, runs array<struct<start:bigint,length:bigint,period:bigint>>" if with_output else ""
    found = rows.mapInArrow(_describe(with_output), f"row {kind}, {_COLUMNS}{more}")
    return found.select(F.col("row.id").alias(id_col), "*").drop("row")


def with_echoes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and text of all documents; a tenth of them, by CRC-32 of the id, repeat a stretch from some word on.

    With h the CRC-32 of the decimal id, g = floor(h / 10) and n words: if h % 10 = 0 and n > 0, each word
    i >= a becomes word a + (i - a) % p, where a = g % n and p = 1 + floor((n - a) / (3 + g % 8)). The words of
    such a text are joined by blanks; other texts and those of null ids stay as they are.
    """
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    words = F.filter(F.split(F.col(text_col).cast("string"), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    chosen = docs.select(
        F.col(id_col),
        F.col(text_col).cast("string").alias(text_col),
        F.floor(h / 10).alias("_g"),
        F.when(h % 10 == 0, words).alias("_words"),
    )
    sized = chosen.withColumn("_n", F.size("_words")).withColumn("_a", F.when(F.col("_n") > 0, F.col("_g") % F.col("_n")))
    period = (1 + F.floor((F.col("_n") - F.col("_a")) / (3 + F.col("_g") % 8))).cast("int")
    placed = sized.withColumn("_a", F.col("_a").cast("int")).withColumn("_p", period)
    echo = F.transform(
        "_words", lambda w, i: F.when(i < F.col("_a"), w).otherwise(F.get("_words", F.col("_a") + (i - F.col("_a")) % F.col("_p")))
    )
    return placed.select(id_col, F.when(F.col("_n") > 0, F.concat_ws(" ", echo)).otherwise(F.col(text_col)).alias(text_col))
