"""Quality rules: surface counts, and a hashed n-gram log-likelihood ratio of trusted and raw text.

Two multinomials over hashed words and word pairs are counted: one over the trusted documents, one
over the whole corpus. A document's score is the mean over its n-grams of the log ratio of their
probabilities; documents under a fixed threshold are not kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelight.llm import arrays as A

BUCKET_BITS = 16
#: Ids of labelled documents that the trusted text is taken from, at most; chosen by hash.
TRUSTED_SAMPLE = 200_000
#: Mean log ratio (nats per n-gram) from which on a document is kept.
MIN_SCORE = -0.35
REPEAT_WORDS = 5
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True


def _blocks_of_words(batches):
    for block in A.blocks(batches):
        data, bytes_at = A.utf8(block.column("text"))
        inside = ~A.BLANKS[data]
        starts, ends, offsets = A.word_bounds(data, bytes_at, inside)
        yield block, data, bytes_at, inside, starts, ends, offsets, A.word_hashes(data, starts, ends)


def gram_buckets(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and document of each word and of each pair of neighbouring words of one document."""
    doc = A.owners(offsets)
    pairs = A.PrefixHash(hashes).grams(2)
    within = np.flatnonzero(doc[1:] == doc[:-1])
    shift = np.uint64(64 - BUCKET_BITS)
    buckets = np.concatenate([A.mixed(hashes) >> shift, pairs[within] >> shift]).astype(np.int64)
    return buckets, np.concatenate([doc, doc[within]])


def _count(batches):
    raw = np.zeros(1 << BUCKET_BITS, np.int64)
    trusted = raw.copy()
    for block, _, _, _, _, _, offsets, hashes in _blocks_of_words(batches):
        buckets, doc = gram_buckets(hashes, offsets)
        raw += np.bincount(buckets, minlength=len(raw))
        good = block.column("trusted").to_numpy(zero_copy_only=False).astype(bool)
        trusted += np.bincount(buckets[good[doc]], minlength=len(raw))
    at = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(trusted[at])], names=["bucket", "raw", "trusted"])


def fit_ratio(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """Log ratio of each bucket: trusted (quality 1, not toxic) over raw, each count plus one.

    The raw counts cover all documents; the trusted ones those of at most ``TRUSTED_SAMPLE`` labelled
    ids. Without trusted text the ratio is zero everywhere.
    """
    ids = (
        labels.filter("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null")
        .select(F.col("doc_id").alias("trusted_id"))
        .distinct()
        .orderBy(F.xxhash64("trusted_id"), "trusted_id")
        .limit(TRUSTED_SAMPLE)
    )
    marked = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(
        F.broadcast(ids), F.col("id") == F.col("trusted_id"), "left"
    )
    counts = (
        marked.select("text", F.col("trusted_id").isNotNull().alias("trusted"))
        .mapInArrow(_count, "bucket long, raw long, trusted long")
        .groupBy("bucket")
        .agg(F.sum("raw").alias("raw"), F.sum("trusted").alias("trusted"))
        .toPandas()
    )
    raw, trusted = np.zeros((2, 1 << BUCKET_BITS))
    raw[counts["bucket"]], trusted[counts["bucket"]] = counts["raw"], counts["trusted"]
    if not trusted.sum():
        return np.zeros_like(raw)
    share = lambda n: np.log((n + 1) / (n.sum() + len(n)))
    return share(trusted) - share(raw)


def _same_as_before(look, doc) -> np.ndarray:
    same = np.zeros(len(look), bool)
    same[1:] = (look[1:] == look[:-1]) & (doc[1:] == doc[:-1])
    return same


def _spellings(data, starts, ends, at) -> np.ndarray:
    """A number for each of the stretches named by ``at``: the same where the bytes are the same."""
    known: dict[bytes, int] = {}
    one, which = np.unique(at, return_inverse=True)
    number = [known.setdefault(data[a:b].tobytes(), len(known)) for a, b in zip(starts[one].tolist(), ends[one].tolist(), strict=True)]
    return np.array(number, np.int64)[which]


def _repeated(data, starts, ends, hashes, offsets):
    """Words inside windows that their document has twice or more."""
    first = A.whole_windows(offsets, REPEAT_WORDS)
    grams = A.PrefixHash(hashes).grams(REPEAT_WORDS)
    if not len(first):
        return np.zeros(len(hashes), bool)
    doc = np.searchsorted(offsets, first, "right") - 1
    window = grams[first]
    order = np.lexsort((window, doc))
    # hashes name candidates; within one hash the words are compared, by the numbers of their spellings
    group = _same_as_before(window[order], doc[order])
    at = np.flatnonzero(group | np.append(group[1:], False))
    word = first[order[at]][:, None] + np.arange(REPEAT_WORDS)
    spelled = _spellings(data, starts, ends, word.reshape(-1)).reshape(-1, REPEAT_WORDS)
    key = np.column_stack([doc[order[at]], spelled])
    _, which, times = np.unique(key, axis=0, return_inverse=True, return_counts=True)
    twice = np.zeros(len(first), bool)
    twice[order[at]] = times[which.reshape(-1)] > 1
    return A.covered(len(hashes), first[twice], first[twice] + REPEAT_WORDS)


def _repeated_lines(data, bytes_at, inside):
    """Per document: lines with a word that equal an earlier line."""
    n_docs = len(bytes_at) - 1
    if not len(data):
        return np.zeros(n_docs, np.int64)
    part = np.ones(len(data), bool)
    part[data == 0x0A] = False
    starts, ends, lines = A.word_bounds(data, bytes_at, part)
    doc = A.owners(lines)
    words = np.append(0, np.cumsum(inside))
    full = words[ends] > words[starts]
    line = np.flatnonzero(full)
    doc, look = doc[full], A.word_hashes(data, starts, ends)[full]
    order = np.lexsort((look, doc))
    group = _same_as_before(look[order], doc[order])
    at = order[np.flatnonzero(group | np.append(group[1:], False))]
    # of equal lines of a document all but one count; equal hashes alone do not
    spelled = np.unique(np.column_stack([doc[at], _spellings(data, starts, ends, line[at])]), axis=0)
    return np.bincount(doc[at], minlength=n_docs) - np.bincount(spelled[:, 0], minlength=n_docs)


def _score(ratio: np.ndarray, min_score: float):
    def run(batches):
        for block, data, bytes_at, inside, starts, ends, offsets, hashes in _blocks_of_words(batches):
            n = block.num_rows
            per_doc = lambda flags, at: np.diff(np.append(0, np.cumsum(flags))[at])
            n_words = np.diff(offsets)
            repeat = per_doc(_repeated(data, starts, ends, hashes, offsets), offsets)
            buckets, doc = gram_buckets(hashes, offsets)
            grams = np.bincount(doc, minlength=n)
            score = np.bincount(doc, weights=ratio[buckets], minlength=n) / np.maximum(grams, 1)
            score = np.round(score, 9)
            failed = (n_words < 10) | (100 * repeat > 20 * n_words)
            counts = [
                n_words,
                per_doc(inside & ((data & 0xC0) != 0x80), bytes_at),
                per_doc(_SYMBOLS[data], bytes_at),
                _repeated_lines(data, bytes_at, inside),
                repeat,
            ]
            yield pa.RecordBatch.from_arrays(
                [block.column("row"), *map(pa.array, [*counts, failed, score, ~failed & (score >= min_score)])],
                names=["row", *_COUNTS, "base_failed", "score", "kept"],
            )

    return run


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_score: float = MIN_SCORE,
    ratio: np.ndarray | None = None,
) -> DataFrame:
    """Each row of ``docs`` (as the struct ``row``) with its counts, base_failed, score and kept.

    Null and empty texts have no words and fail. Rows may repeat or have null ids; columns of
    ``docs`` may have any names. Labels with nulls are not trusted. A score equal to ``min_score`` is kept.
    """
    if ratio is None:
        ratio = fit_ratio(docs, labels, id_col, text_col)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(row, F.col(text_col).cast("string").alias("text"))
    kind = rows.select("row").schema.toDDL()
    counts = ", ".join(f"{c} long" for c in _COUNTS)
    return rows.mapInArrow(_score(ratio, min_score), f"{kind}, {counts}, base_failed boolean, score double, kept boolean")
