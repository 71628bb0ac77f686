"""Benchmark passages in training documents, by suffix arrays over shards of the training text.

Each block of documents is a shard: its word suffixes (those that consist of benchmark words for at
least the shortest window) are sorted, every benchmark suffix is looked up by binary search, and the
suffixes in its range are verbatim occurrences. The words of each occurrence are compared before it counts.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelight.llm import arrays as A
from tracelight.llm.repeats import same_bytes
from tracelight.llm.tables import gathered

WINDOW_WORDS = 10
#: Benchmark text that goes to the tasks at once; a larger benchmark is searched in several rounds.
ROUND_BYTES = 8_000_000


class Tests(NamedTuple):
    """Windows of one round of benchmark items, by word number; number 0 is no benchmark word."""

    data: np.ndarray
    starts: np.ndarray  # of words
    ends: np.ndarray
    vocabulary: np.ndarray  # sorted word hashes
    low: np.ndarray  # sort keys of each window, followed by the least
    high: np.ndarray  # and by the greatest numbers
    first: np.ndarray  # first word of each window
    width: np.ndarray
    item: np.ndarray
    ids: list[str]
    bits: int


def _words(texts: pa.Array):
    data, offsets = A.utf8(texts)
    data = A.LOWER[data]
    starts, ends, offsets = A.word_bounds(data, offsets, A.ALNUM[data])
    return data, starts, ends, offsets


def _keys(numbers: np.ndarray, fill: int, window: int, bits: int) -> np.ndarray:
    """Rows of word numbers as byte strings that sort like the rows; ``fill`` pads to ``window``."""
    width = 2 if bits <= 16 else 4
    padded = np.full((len(numbers), window), fill, f">u{width}")
    padded[:, : numbers.shape[1]] = numbers
    return padded.view(f"S{window * width}").reshape(-1)


def compile_tests(items: list[tuple], window: int) -> Tests:
    data, starts, ends, offsets = _words(pa.array([t for _, t in items], pa.string()))
    hashes = A.word_hashes(data, starts, ends)
    vocabulary = np.unique(hashes)
    numbers = np.searchsorted(vocabulary, hashes) + 1
    bits = 16 if len(vocabulary) < 0xFFFF else 32
    top = (1 << bits) - 1
    low, high, first, width, item = [], [], [], [], []
    for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
        if (n := min(window, b - a)) > 0:
            at = np.arange(a, b - n + 1)
            rows = numbers[at[:, None] + np.arange(n)]
            low.append(_keys(rows, 0, window, bits))
            high.append(_keys(rows, top, window, bits))
            first.append(at)
            width.append(np.full(len(at), n))
            item.append(np.full(len(at), i))
    joined = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (low, high, first, width, item)]
    return Tests(data, starts, ends, vocabulary, *joined, ["" if i is None else str(i) for i, _ in items], bits)


def occurrences(tests: Tests, data, starts, ends, offsets, window: int):
    """All (word position, benchmark window) that agree, over one block of documents."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(starts) or not len(tests.first):
        return none
    hashes = A.word_hashes(data, starts, ends)
    found = np.searchsorted(tests.vocabulary, hashes)
    found[found == len(tests.vocabulary)] = 0
    numbers = np.where(tests.vocabulary[found] == hashes, found + 1, 0)
    known = np.append(0, np.cumsum(numbers > 0))
    shortest = int(tests.width.min())
    doc_end = offsets[1:][A.owners(offsets)]
    at = np.arange(len(starts))
    at = at[at + shortest <= doc_end]
    at = at[known[at + shortest] - known[at] == shortest]
    if not len(at):
        return none
    place = at[:, None] + np.arange(window)
    inside = place < doc_end[at][:, None]
    keys = _keys(np.where(inside, numbers[np.minimum(place, len(numbers) - 1)], 0), 0, window, tests.bits)
    order = np.argsort(keys, kind="stable")  # the suffix array of this shard
    ranked = keys[order]
    left, right = np.searchsorted(ranked, tests.low, "left"), np.searchsorted(ranked, tests.high, "right")
    ranges, member = gathered(left, right)
    test = np.repeat(np.arange(len(left)), np.diff(ranges))
    position = at[order[member]]
    good = position + tests.width[test] <= doc_end[position]
    position, test = position[good], test[good]
    # the words themselves
    words_at, word = gathered(position, position + tests.width[test])
    _, theirs = gathered(tests.first[test], tests.first[test] + tests.width[test])
    both = np.concatenate([data, tests.data])
    mine, other = ends[word] - starts[word], tests.ends[theirs] - tests.starts[theirs]
    differ = (mine != other) | ~same_bytes(both, starts[word], tests.starts[theirs] + len(data), np.minimum(mine, other))
    wrong = np.append(0, np.cumsum(differ))
    same = wrong[words_at[1:]] == wrong[words_at[:-1]]
    return position[same], test[same]


_FOUND = "hits array<struct<first:long,last:long>>, items array<string>"


def _search(tests: Tests, window: int, names: list[str]):
    """Adds this round's hit words and items to each row."""

    def run(batches):
        for block in A.blocks(batches):
            data, starts, ends, offsets = _words(block.column("text"))
            position, test = occurrences(tests, data, starts, ends, offsets, window)
            gone = A.covered(len(starts), position, position + tests.width[test])
            doc = np.searchsorted(offsets, position, "right") - 1
            pairs = np.unique(np.stack([doc, tests.item[test]]), axis=1) if len(doc) else np.zeros((2, 0), np.int64)
            items = [list(x) for x in block.column("items").to_pylist()]
            for d, i in pairs.T.tolist():
                items[d].append(tests.ids[i])
            hits = [list(x) for x in block.column("hits").to_pylist()]
            for d in np.unique(doc).tolist():
                own = np.append(0, gone[offsets[d] : offsets[d + 1]].view(np.int8))
                edge = np.diff(np.append(own, 0))
                hits[d] += [
                    {"first": int(a), "last": int(b)}
                    for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)
                ]
            columns = {n: block.column(n) for n in block.schema.names}
            columns["hits"] = pa.array(hits, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])))
            columns["items"] = pa.array(items, pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], names=names)

    return run


def _report(batches):
    for block in A.blocks(batches):
        _, starts, _, offsets = _words(block.column("text"))
        n_hit, n_items, digest = [], [], []
        for hits, items in zip(block.column("hits").to_pylist(), block.column("items").to_pylist(), strict=True):
            n = max((h["last"] for h in hits), default=0)
            own = A.covered(n, np.array([h["first"] for h in hits], int), np.array([h["last"] for h in hits], int))
            distinct = sorted(set(items))
            n_hit.append(int(own.sum()))
            n_items.append(len(distinct))
            digest.append(hashlib.sha256(",".join(distinct).encode()).hexdigest())
        columns = {
            "n_words": pa.array(np.diff(offsets)),
            "n_hit": pa.array(n_hit, pa.int64()),
            "n_items": pa.array(n_items, pa.int64()),
            "items_sha256": pa.array(digest),
            "contaminated": pa.array([n > 0 for n in n_hit]),
        }
        kept = [n for n in block.schema.names]
        yield pa.RecordBatch.from_arrays([block.column(n) for n in kept] + list(columns.values()), names=kept + list(columns))


_REPORTED = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _reporting(search):
    """A search whose rows are reported in the same Python worker."""

    def run(batches):
        return _report(search(batches))

    return run


def _fields(df: DataFrame) -> str:
    return df.schema.toDDL()


def find_passages(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW_WORDS,
    round_bytes: int = ROUND_BYTES,
) -> DataFrame:
    """Each row of ``docs`` (as the struct ``row``) with what it shares with the benchmark.

    Also: ``hits`` (stretches [first, last) of words inside occurrences, longest matches joined),
    ``items`` (ids of items found), n_words, n_hit, n_items, items_sha256, contaminated.

    A window is ``window`` consecutive words of an item, or a shorter item as a whole. Null and empty
    texts have no words; items without words find nothing. Null item ids are written as empty strings;
    items of one id count once. Documents may repeat or have null ids. Without items nothing is hit.
    Columns of ``docs`` may have any names.

    The benchmark goes to the tasks in rounds of at most ``round_bytes`` (or one item); no table is
    shuffled. The text goes through each round in place.
    """
    size = benchmark.agg(F.coalesce(F.sum(F.octet_length(F.col(item_text_col).cast("string"))), F.lit(0))).first()[0]
    rounds = int(size // round_bytes) + 1
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col(text_col).cast("string").alias("text"),
        F.array().cast("array<struct<first:bigint,last:bigint>>").alias("hits"),
        F.array().cast("array<string>").alias("items"),
    )
    items = benchmark.select(
        F.col(item_col).cast("string").alias("item"), F.col(item_text_col).cast("string").alias("words")
    )
    for r in range(rounds):
        part = items.filter(F.pmod(F.xxhash64("item", "words"), F.lit(rounds)) == r)
        tests = compile_tests(sorted((tuple(x) for x in part.collect()), key=str), window)
        search, fields = _search(tests, window, rows.columns), _fields(rows)
        if r == rounds - 1:
            search, fields = _reporting(search), f"{fields}, {_REPORTED}"
        rows = rows.mapInArrow(search, fields)
    return rows.drop("text")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that share no passage with the benchmark, columns as they are."""
    return find_passages(docs, benchmark, **options).filter("not contaminated").select("row.*")
