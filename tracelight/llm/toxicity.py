"""Toxicity by a classifier that does not care which group a text names (counterfactual regularisation).

A text is described by its words, their beginnings and their ends, each by how often it comes in a hundred
words, and by its length. The features that tell toxic labelled texts from others best are chosen by their
log-likelihood ratio over grouped counts. A logistic model of them is fitted with a further penalty: in
every labelled text the identity terms of its sentences are swapped for others of the same kind (women
for men, one faith for another), and the squared change of the score counts against the model. So the
name of a group that toxic texts attack often gets no weight of its own, and neutral mentions of it stay
below the threshold.

The model is fitted by L-BFGS; every step is one pass over the stored rows of the labelled sample, in
which each task returns a gradient of at most ``FEATURES`` numbers.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelight.llm import arrays as A
from tracelight.llm.tables import stored

#: Labelled ids that the model is fitted on, at most; chosen by hash of the id.
LABELLED_SAMPLE = 200_000
#: Features of the model, at most.
FEATURES = 512
#: Labelled texts that a feature must occur in.
MIN_TEXTS = 3
#: Bytes of the beginnings and ends of words that are features.
AFFIXES = (4, 6, 8)
#: Weights of the squared model and of the squared changes of score under swapped identity terms.
SHRINK = 0.1
COUNTERFACTUAL = 1.0
#: Largest gradient, per labelled text, with which the fit has converged, and steps after which it ends anyway.
TOLERANCE = 3e-5
MAX_STEPS = 60
THRESHOLD = 0.5
_PARTS = 16
_SPAN = 4_000_000

#: Identity terms by kind; a term is swapped for the next of its line, the last for the first.
IDENTITY_TERMS = (
    ("women", "men"),
    ("woman", "man"),
    ("girls", "boys"),
    ("girl", "boy"),
    ("female", "male"),
    ("wife", "husband"),
    ("mother", "father"),
    ("daughter", "son"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "arab"),
    ("african", "european", "american", "mexican", "chinese", "indian"),
    ("africans", "europeans", "americans", "mexicans", "indians"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "queer"),
    ("immigrant", "citizen", "refugee", "foreigner"),
    ("immigrants", "citizens", "refugees", "foreigners"),
    ("blind", "deaf", "disabled", "autistic"),
    ("young", "old", "elderly"),
    ("frauen", "männer"),
    ("frau", "mann"),
    ("mädchen", "junge"),
    ("christen", "muslime", "juden", "hindus"),
    ("ausländer", "inländer", "flüchtlinge", "einwanderer"),
    ("femmes", "hommes"),
    ("femme", "homme"),
    ("filles", "garçons"),
    ("chrétiens", "musulmans", "juifs", "hindous"),
    ("immigrés", "étrangers", "réfugiés", "citoyens"),
    ("mujeres", "hombres"),
    ("mujer", "hombre"),
    ("niñas", "niños"),
    ("cristianos", "musulmanes", "judíos", "hindúes"),
    ("inmigrantes", "extranjeros", "refugiados", "ciudadanos"),
)


class Words(NamedTuple):
    """Distinct words of each text of a block: their text, bytes, hashes and how often they come."""

    doc: np.ndarray
    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    times: np.ndarray


def _grouped(doc: np.ndarray, value: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """One place of each pair of document and value, and how often the pair comes."""
    order = np.lexsort((value, doc))
    new = np.ones(len(order), bool)
    new[1:] = (value[order][1:] != value[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    at = np.flatnonzero(new)
    if times is None:
        return order[at], np.diff(np.append(at, len(order)))
    return order[at], np.add.reduceat(times[order], at) if len(at) else times[:0]


def distinct_words(texts: pa.Array) -> tuple[Words, np.ndarray]:
    """Words of lower-cased letters, digits and bytes beyond ASCII, each once a text; and the texts' lengths in words."""
    data, bytes_at = A.utf8(pc.utf8_lower(pc.fill_null(texts, "").cast(pa.large_string())))
    starts, ends, offsets = A.word_bounds(data, bytes_at, A.ALNUM[data])
    hashes = A.word_hashes(data, starts, ends)
    doc = A.owners(offsets)
    one, times = _grouped(doc, hashes)
    return Words(doc[one], data, starts[one], ends[one], hashes[one], times), np.diff(offsets)


def features_of(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, hash and count of every feature: words, and beginnings and ends of longer words."""
    prefix = A.PrefixHash(words.data)
    docs, found, times = [words.doc], [A.mixed(words.hash)], [words.times]
    size = words.end - words.start
    for n in AFFIXES:
        long = np.flatnonzero(size > n)
        start, end = words.start[long], words.end[long]
        docs += [words.doc[long]] * 2
        times += [words.times[long]] * 2
        found += [A.mixed(prefix.of(start, start + n) + np.uint64(2 * n)), A.mixed(prefix.of(end - n, end) + np.uint64(2 * n + 1))]
    doc, feature = np.concatenate(docs), np.concatenate(found)
    one, count = _grouped(doc, feature, np.concatenate(times))
    return doc[one], feature[one], count


class Swaps:
    """Identity terms, and for each the one that it is swapped for."""

    def __init__(self, terms: tuple[tuple[str, ...], ...] = IDENTITY_TERMS):
        pairs = [(a.encode(), b.encode()) for line in terms for a, b in zip(line, line[1:] + line[:1], strict=True)]
        self.bytes = np.frombuffer(b" ".join(a for a, _ in pairs), np.uint8)
        size = np.array([len(a) for a, _ in pairs], np.int64)
        start = np.append(0, np.cumsum(size + 1)[:-1])
        hashes = A.word_hashes(self.bytes, start, start + size) if len(pairs) else np.zeros(0, np.uint64)
        order = np.argsort(hashes, kind="stable")
        where = {a: i for i, (a, _) in enumerate(pairs)}
        partner = np.array([where[b] for _, b in pairs], np.int64)
        self.hashes = hashes[order]
        self.start, self.end, self.partner_hash = start[partner][order], (start + size)[partner][order], hashes[partner][order]

    def apply(self, words: Words) -> Words:
        """The texts that have an identity term, with their terms swapped; other texts have no words here."""
        if not len(self.hashes):
            return Words(*(x[:0] if k != 1 else x for k, x in enumerate(words)))
        at = np.minimum(np.searchsorted(self.hashes, words.hash), len(self.hashes) - 1)
        term = self.hashes[at] == words.hash
        mine = np.isin(words.doc, words.doc[term])
        at, term = at[mine], term[mine]
        shift = len(words.data)
        return Words(
            words.doc[mine],
            np.concatenate([words.data, self.bytes]),
            np.where(term, self.start[at] + shift, words.start[mine]),
            np.where(term, self.end[at] + shift, words.end[mine]),
            np.where(term, self.partner_hash[at], words.hash[mine]),
            words.times[mine],
        )


def _spans(block: pa.RecordBatch, column: str = "text"):
    """Texts of the block, a long one in parts cut at blanks: (row numbers, texts)."""
    texts = block.column(column)
    if block.num_rows > 1 or (pc.sum(pc.binary_length(texts)).as_py() or 0) <= _SPAN:
        yield np.arange(block.num_rows), texts
        return
    text = texts[0].as_py()
    at = 0
    while at < len(text):
        end = at + _SPAN
        while end < len(text) and text[end].isalnum():
            end += 1
        yield np.zeros(1, np.int64), pa.array([text[at:end]])
        at = end


def _count(batches):
    """Labelled texts that have each feature, and toxic ones among them, for one block after the other."""
    for block in A.blocks(batches):
        toxic = block.column("toxic").to_numpy()
        for rows, texts in _spans(block):
            doc, feature, _ = features_of(distinct_words(texts)[0])
            one, same = np.unique(feature, return_inverse=True)
            n = np.bincount(same, minlength=len(one))
            bad = np.bincount(same, weights=toxic[rows][doc], minlength=len(one)).astype(np.int64)
            for i in range(0, len(one), 50_000):
                some = slice(i, i + 50_000)
                columns = [pa.array(c[some]) for c in (one.view(np.int64), n, bad)]
                yield pa.RecordBatch.from_arrays(columns, names=["feature", "n", "bad"])


def _gain(n: Column, bad: Column, texts: int, toxic: int) -> Column:
    """Log-likelihood ratio of the feature's share in toxic texts against its share in the others."""

    def part(k: Column, size: Column) -> Column:
        return F.when((k > 0) & (k < size), k * F.log(k / size) + (size - k) * F.log((size - k) / size)).otherwise(0.0)

    clean = float(texts - toxic)
    return part(bad, F.lit(float(toxic))) + part(n - bad, F.lit(clean)) - part(n, F.lit(float(texts)))


class Model(NamedTuple):
    """Chosen features (sorted hashes), their weights, those of length and bias, and the share of toxic texts."""

    features: np.ndarray
    weights: np.ndarray
    length: float
    bias: float
    share: float


def training_share(id_column: Column) -> Column:
    """Whether labels of this id may be learnt from: CRC-32 of the id's text modulo 5 is not 0. Null: no."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 5 != 0, F.lit(False))


def labelled_texts(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(text, toxic 0 or 1) of the rows of ``docs`` whose id is among the labelled sample."""
    known = (
        labels.filter("doc_id is not null and toxic in (0, 1)")
        .filter(training_share(F.col("doc_id")))
        .groupBy(F.col("doc_id").alias("known_id"))
        .agg(F.max("toxic").cast("int").alias("toxic"))
        .orderBy(F.xxhash64("known_id"), "known_id")
        .limit(LABELLED_SAMPLE)
    )
    texts = docs.select(F.col(f"`{id_col}`").alias("own_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return texts.join(F.broadcast(known), F.col("own_id") == F.col("known_id")).select("text", "toxic")


def _chosen(features: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, number and count of the model's features."""
    doc, feature, times = features_of(words)
    if not len(features):
        return doc[:0], doc[:0], times[:0]
    at = np.minimum(np.searchsorted(features, feature), len(features) - 1)
    hit = features[at] == feature
    return doc[hit], at[hit], times[hit]


def _described(block: pa.RecordBatch, features: np.ndarray, swaps: Swaps | None = None):
    """Words of each text; its features (text, number, value); and those of its swapped form, with who has one."""
    n = block.num_rows
    size, named = np.zeros(n, np.int64), np.zeros(n, bool)
    own, other = [], []
    for rows, texts in _spans(block):
        words, length = distinct_words(texts)
        size[rows] += length
        own.append(_chosen(features, words))
        if swaps:
            swapped = swaps.apply(words)
            named[swapped.doc] = True
            # a part of a long text that names no group stays as it is
            other.append(_chosen(features, swapped) if n > 1 or len(swapped.doc) else own[-1])

    def valued(parts):
        doc, number, times = (np.concatenate(c) for c in zip(*parts, strict=True)) if parts else np.zeros((3, 0), np.int64)
        one, times = _grouped(doc, number, times)
        doc, number = doc[one], number[one]
        return doc, number, np.log1p(100 * times / np.maximum(size[doc], 1))

    return size, valued(own), valued(other) if swaps else None, named


def _training_rows(features: np.ndarray, swaps: Swaps):
    """Per labelled text its length and features, and those of its swapped form (null if it names no group)."""

    def packed(n: int, doc, number, value, present=None):
        at = np.append(0, np.cumsum(np.bincount(doc, minlength=n)))
        number, value = number.astype(np.int16), value.astype(np.float32)
        some = range(n) if present is None else [k if p else None for k, p in enumerate(present)]
        for column in (number, value):
            yield pa.array([None if k is None else column[at[k] : at[k + 1]].tobytes() for k in some], pa.binary())

    def run(batches):
        for block in A.blocks(batches):
            size, own, other, named = _described(block, features, swaps)
            columns = [block.column("toxic"), pa.array(size), *packed(block.num_rows, *own), *packed(block.num_rows, *other, named)]
            yield pa.RecordBatch.from_arrays(columns, names=["toxic", "size", "own", "own_value", "swapped", "swapped_value"])

    return run


def _length(size: np.ndarray) -> np.ndarray:
    return np.log1p(size) / 5


def _loss(x: np.ndarray, counterfactual: float):
    """Loss and gradient of the rows of one task; ``x`` has the weights, then those of length and bias."""
    weights = x[:-2]

    def score(numbers: list[bytes], values: list[bytes]):
        number = np.frombuffer(b"".join(numbers), np.int16).astype(np.int64)
        value = np.frombuffer(b"".join(values), np.float32).astype(float)
        row = np.repeat(np.arange(len(numbers)), [len(n) // 2 for n in numbers])
        return number, value, row, np.bincount(row, weights=weights[number] * value, minlength=len(numbers))

    def run(batches):
        loss, slope = 0.0, np.zeros(len(x))
        pulled = lambda number, weight: np.bincount(number, weights=weight, minlength=len(weights))
        for batch in batches:
            y = batch.column("toxic").to_numpy().astype(float)
            length = _length(batch.column("size").to_numpy())
            number, value, row, own = score(*(batch.column(c).to_pylist() for c in ("own", "own_value")))
            z = own + x[-2] * length + x[-1]
            loss += float((np.logaddexp(0, z) - y * z).sum())
            off = 0.5 * (1 + np.tanh(z / 2)) - y
            slope[:-2] += pulled(number, off[row] * value)
            slope[-2:] += (off * length).sum(), off.sum()
            named = np.flatnonzero(batch.column("swapped").is_valid().to_numpy(zero_copy_only=False))
            if len(named):
                columns = (batch.column(c).drop_null().to_pylist() for c in ("swapped", "swapped_value"))
                other, other_value, other_row, swapped = score(*columns)
                change = np.zeros(len(y))
                change[named] = counterfactual * (own[named] - swapped)
                loss += float((change[named] * (own[named] - swapped)).sum()) / 2
                slope[:-2] += pulled(number, change[row] * value) - pulled(other, change[named][other_row] * other_value)
        yield pa.RecordBatch.from_arrays([pa.array([loss]), pa.array([slope.tobytes()], pa.binary())], names=["loss", "slope"])

    return run


def _minimum(value, size: int, tolerance: float) -> np.ndarray:
    """L-BFGS: the point where the convex ``value`` (loss, gradient) has no slope left."""
    x = np.zeros(size)
    loss, slope = value(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(MAX_STEPS):
        if np.abs(slope).max() <= tolerance:
            break
        step, shares = slope.copy(), []
        for s, y in reversed(past):
            shares.append((s @ step) / (s @ y))
            step -= shares[-1] * y
        step *= past[-1][0] @ past[-1][1] / (past[-1][1] @ past[-1][1]) if past else 1 / max(1.0, np.abs(slope).sum())
        for (s, y), share in zip(past, reversed(shares), strict=True):
            step += (share - (y @ step) / (s @ y)) * s
        length = 1.0
        while length > 1e-8:
            there, at = value(x - length * step)
            if there <= loss - 1e-4 * length * (slope @ step):
                break
            length /= 2
        else:
            break
        s, y = -length * step, at - slope
        x, loss, slope = x + s, there, at
        if s @ y > 1e-12:
            past = [*past[-9:], (s, y)]
    return x


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    terms: tuple[tuple[str, ...], ...] = IDENTITY_TERMS,
    counterfactual: float = COUNTERFACTUAL,
) -> Model | None:
    """The model of the labelled sample; None unless it has toxic and other texts."""
    texts = stored(labelled_texts(docs, labels, id_col, text_col), "labelled")
    size = texts.agg(F.count("*").alias("texts"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")).first()
    if not 0 < size.toxic < size.texts:
        return None
    counts = texts.mapInArrow(_count, "feature long, n long, bad long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    chosen = (
        counts.filter(F.col("n") >= MIN_TEXTS)
        .select("feature", _gain(F.col("n"), F.col("bad"), size.texts, size.toxic).alias("gain"))
        .orderBy(F.desc(F.round("gain", 6)), "feature")
        .limit(FEATURES)
        .collect()
    )
    features = np.sort(np.array([r.feature for r in chosen], np.int64).view(np.uint64))
    described = texts.mapInArrow(
        _training_rows(features, Swaps(terms)),
        "toxic int, size long, own binary, own_value binary, swapped binary, swapped_value binary",
    )
    rows = stored(described.repartition(_PARTS), "training")

    def value(x: np.ndarray) -> tuple[float, np.ndarray]:
        parts = rows.mapInArrow(_loss(x, counterfactual), "loss double, slope binary").collect()
        # summed in an order of their own, so that a rerun comes to the same model
        parts = sorted((p.loss, bytes(p.slope)) for p in parts)
        shrunk = np.append(SHRINK * x[:-2], [0, 0])
        loss = sum(p[0] for p in parts) + float(shrunk @ x) / 2
        return loss, sum(np.frombuffer(p[1], float) for p in parts) + shrunk

    x = _minimum(value, len(features) + 2, TOLERANCE * size.texts)
    return Model(features, x[:-2], float(x[-2]), float(x[-1]), size.toxic / size.texts)


def _scores(model: Model | None):
    def run(batches):
        for block in A.blocks(batches, limit=A.SMALL_BLOCK_BYTES):
            score = np.zeros(block.num_rows)
            if model is not None:
                size, (doc, number, value), _, _ = _described(block, model.features)
                # a sum of no features at all comes in whole numbers, so nothing is added in place
                z = np.bincount(doc, weights=model.weights[number] * value, minlength=block.num_rows)
                z = z + (model.length * _length(size) + model.bias)
                score = np.round(np.where(size > 0, 0.5 * (1 + np.tanh(z / 2)), model.share), 9)
            predicted = (score >= THRESHOLD).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [block.column("row"), pa.array(score), pa.array(predicted)], names=["row", "score", "predicted"]
            )

    return run


def judge_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    model: Model | None = None,
    terms: tuple[tuple[str, ...], ...] = IDENTITY_TERMS,
    counterfactual: float = COUNTERFACTUAL,
) -> DataFrame:
    """Per row its id, ``held_out`` (its label is never learnt from), ``score`` from 0 to 1 and ``predicted``.

    Null texts and those without words get the share of toxic texts among the labelled ones. Rows may repeat; rows of null id
    are scored, and count as not held out. Of several labels of an id the greatest counts, labels other
    than 0 and 1 do not. Without toxic or without other labelled texts every score is 0. A score of
    exactly ``THRESHOLD`` is predicted 1. Other columns of ``docs`` are not looked at. An empty table gives
    an empty result. Texts beyond 4 MB are read in parts cut between words.
    """
    if model is None:
        model = fit_toxicity(docs, labels, id_col, text_col, terms, counterfactual)
    row = F.struct(F.col(f"`{id_col}`").alias("id")).alias("row")
    rows = docs.select(row, F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    scored = rows.mapInArrow(_scores(model), f"row {kind}, score double, predicted int")
    held = F.col("row.id").isNotNull() & ~training_share(F.col("row.id"))
    return scored.select(F.col("row.id").alias(id_col), held.alias("held_out"), "score", "predicted")
