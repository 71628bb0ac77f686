"""Language of each document from text, declared language, address suffix and host, fused by Bayes' rule.

1. The languages are those that enough rows declare. Hashed character trigrams are counted for each: a
   multinomial, whose counts are discounted by one, so what was seen once is no better than unseen. One
   more class, the background, stands for all other text: single bytes of the corpus, or any bucket alike.
2. Every document's trigram likelihoods are evaluated once and stored without the text.
3. Grouped aggregation over those rows gives how often each language is declared, which address
   suffixes it has and which languages each host and each address suffix has.
4. The posterior multiplies the text likelihood with declared language and suffix likelihoods and with
   the host's prior, which is smoothed towards its suffix's, and that towards the whole corpus.
"""

from __future__ import annotations

import warnings
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelight.llm import arrays as A
from tracelight.llm.tables import row_keyed, stored

#: Rows whose declaration is enough for a language. One that fewer declare, two at least, is a language if its
#: rows agree: of their trigrams at least this share is found in two or more of them.
MIN_SUPPORT = 10
MIN_SHARED = 0.5
#: More declared languages than this are an error: their counts would not fit the tasks.
MAX_LANGUAGES = 256
BUCKET_BITS = 15
#: Trigrams of a text that count in full as evidence; longer texts weigh as much as this many.
EVIDENCE = 40.0
#: Rows that a parent's prior counts for in a host's.
SMOOTHING = 20.0
#: Posterior that the best language needs, else the language is unknown.
MIN_POSTERIOR = 0.6
_GRAM = 3


def _trigrams(block: pa.RecordBatch):
    """Bucket, document and the three bytes of each trigram."""
    data, offsets = A.utf8(block.column("text"))
    data = A.LOWER[data]
    data = np.where(A.ALNUM[data] & ~((data >= 0x30) & (data <= 0x39)), data, 0x20).astype(np.uint8)
    first = A.whole_windows(offsets, _GRAM)
    solid = (data[first] != 0x20) | (data[first + 1] != 0x20) if len(first) else np.zeros(0, bool)
    first = first[solid]
    buckets = (A.PrefixHash(data).grams(_GRAM)[first] >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    return buckets, np.searchsorted(offsets, first, "right") - 1, [data[first + i] for i in range(_GRAM)]


class LanguageWarning(UserWarning):
    """Some declared values are no languages of the model, as too few rows or no like rows declare them."""


def _own_trigrams(batches):
    """Each trigram bucket of a row once, with its count."""
    for block in A.blocks(batches):
        buckets, doc, _ = _trigrams(block)
        pair, times = np.unique(doc << BUCKET_BITS | buckets, return_counts=True)
        declared = block.column("declared").take(pa.array(pair >> BUCKET_BITS))
        columns = [declared, pa.array(pair & ((1 << BUCKET_BITS) - 1)), pa.array(times)]
        yield pa.RecordBatch.from_arrays(columns, names=["declared", "bucket", "n"])


def declared_languages(rows: DataFrame, min_support: int = MIN_SUPPORT) -> tuple[str, ...]:
    """The values of ``declared`` that are languages, in order; a ``LanguageWarning`` names the others.

    A value is one if ``min_support`` rows have it, or if two or more have it and are alike.
    """
    counts = rows.filter("declared <> ''").groupBy("declared").count()
    found = {r.declared for r in counts.filter(F.col("count") >= min_support).limit(MAX_LANGUAGES + 1).collect()}
    # the rarer ones have fewer rows than ``min_support`` each
    rare = counts.filter((F.col("count") < min_support) & (F.col("count") >= 2)).select("declared")
    trigrams = rows.select("text", "declared").join(rare, "declared").mapInArrow(_own_trigrams, "declared string, bucket long, n long")
    shared = (
        trigrams.groupBy("declared", "bucket")
        .agg(F.count("*").alias("rows"), F.sum("n").alias("n"))
        .groupBy("declared")
        .agg((F.sum(F.when(F.col("rows") > 1, F.col("n")).otherwise(0)) / F.sum("n")).alias("share"))
    )
    found |= {r.declared for r in shared.filter(F.col("share") >= MIN_SHARED).limit(MAX_LANGUAGES + 1).collect()}
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} declared languages")
    odd = counts.filter(~F.col("declared").isin(*found)) if found else counts
    left = [r.declared for r in odd.orderBy("declared").limit(20).collect()]
    if left:
        warnings.warn(f"declared by too few rows, or by rows that share nothing: {left}", LanguageWarning, stacklevel=2)
    return tuple(sorted(found))


def _count(languages: tuple[str, ...]):
    size = len(languages)

    def run(batches):
        # one row for each language; the last has the bytes that their trigrams begin with
        total = np.zeros((size + 1, 1 << BUCKET_BITS), np.int64)
        for block in A.blocks(batches, limit=A.SMALL_BLOCK_BYTES):
            buckets, doc, data = _trigrams(block)
            declared = pc.index_in(block.column("declared"), pa.array(languages, pa.string()))
            declared = declared.fill_null(-1).to_numpy()[doc]
            listed = declared >= 0
            place, n = np.unique(declared[listed].astype(np.int64) * total.shape[1] + buckets[listed], return_counts=True)
            total.reshape(-1)[place] += n
            total[size, :256] += np.bincount(data[0][listed], minlength=256)
        language, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(language), pa.array(bucket), pa.array(total[language, bucket])], names=["language", "bucket", "n"]
        )

    return run


def fit_text(rows: DataFrame, languages: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Log probability of each trigram bucket in each language, from all rows that declare it, and of each byte."""
    size, width = len(languages), 1 << BUCKET_BITS
    counts = (
        rows.select("text", "declared")
        .mapInArrow(_count(languages), "language long, bucket long, n long")
        .groupBy("language", "bucket")
        .agg(F.sum("n").alias("n"))
        .toPandas()
    )
    n = np.zeros((size + 1, width))
    n[counts["language"], counts["bucket"]] += counts["n"]
    seen = n[:size]
    # what the discount takes is spread over all buckets
    left = np.maximum((seen > 0).sum(axis=1, keepdims=True), 1) / width
    smooth = np.maximum(seen - 1, 0) + left
    single = n[size, :256] + 1
    return np.log(smooth / smooth.sum(axis=1, keepdims=True)), np.log(single / single.sum())


def _likelihoods(model: np.ndarray, single: np.ndarray):
    size = len(model)

    def run(batches):
        for block in A.blocks(batches, limit=A.SMALL_BLOCK_BYTES):
            buckets, doc, data = _trigrams(block)
            n = np.bincount(doc, minlength=block.num_rows)
            other = np.logaddexp(sum(single[d] for d in data), -BUCKET_BITS * np.log(2)) - np.log(2)
            logs = [np.bincount(doc, weights=m[buckets], minlength=block.num_rows) for m in model]
            logs.append(np.bincount(doc, weights=other, minlength=block.num_rows))
            weight = np.minimum(n, EVIDENCE) / np.maximum(n, 1)
            values = np.round(np.stack(logs, axis=1) * weight[:, None], 6)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(values.reshape(-1)), size + 1).cast(pa.list_(pa.float64()))
            columns = [block.column(c) for c in ("rid", "declared", "host", "suffix")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n), lists], names=[*_EVIDENCE, "n_trigrams", "logs"])

    return run


_EVIDENCE = ("rid", "declared", "host", "suffix")


def markup_language(html: Column) -> Column:
    """The language that the markup's first ``lang`` attribute declares: two or three letters, else null."""
    found = F.regexp_extract(html, r"""(?i)<html[^>]*\blang\s*=\s*["']?([a-z]{2,3})\b""", 1)
    return F.nullif(F.lower(found), F.lit(""))


def address_suffix(host: Column) -> Column:
    """The last label of a host that has a dot, else null."""
    return F.when(F.contains(host, F.lit(".")), F.substring_index(host, ".", -1))


def _shares(rows: DataFrame, key: str, size: int) -> DataFrame:
    """Rows of each of ``size`` classes for each value of ``key``."""
    counts = [F.count_if(F.col("guess") == i).cast("double") for i in range(size)]
    return rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.array(*counts).alias(f"n_{key}"))


def identify(
    rows: DataFrame, languages: tuple[str, ...] | None = None, min_posterior: float = MIN_POSTERIOR
) -> DataFrame:
    """rid, lang, posterior, n_trigrams, kept of rows (rid, text, declared, host, suffix).

    ``languages`` are by default those that enough rows declare. Null text, no letters: no text evidence.
    Null or unlisted declared languages, null hosts and null suffixes are no evidence. ``lang`` is null
    where the background is likelier than any language. A row is kept if it has letters and its best
    class is a language that reaches ``min_posterior``; of equal posteriors the first language counts.
    """
    languages = declared_languages(rows) if languages is None else languages
    size = len(languages) + 1  # the last class is the background
    model = fit_text(rows, languages)
    schema = "rid long, declared string, host string, suffix string, n_trigrams long, logs array<double>"
    seen = stored(
        rows.select("text", *_EVIDENCE).mapInArrow(_likelihoods(*model), schema)
        .withColumn("guess", F.expr("if(n_trigrams > 0, array_position(logs, array_max(logs)) - 1, null)")),
        "language",
    )
    n, told = np.zeros(size), np.ones((size, len(languages)))
    known = F.when(F.col("declared").isin(*languages), F.col("declared")).alias("declared")
    for r in seen.filter("guess is not null").groupBy("guess", known).count().collect():
        n[r.guess] += r["count"]
        if r.declared is not None:
            told[r.guess, languages.index(r.declared)] += r["count"]
    base = (n + 1) / (n + 1).sum()
    told = np.log(told / told.sum(axis=1, keepdims=True))
    words = [(d, told[:, k].tolist()) for k, d in enumerate(languages)]
    words = rows.sparkSession.createDataFrame(words, "declared string, told array<double>")
    # suffix: likelihood of a language up to a factor, share of the suffix's rows over share of all rows
    suffixes = _shares(seen, "suffix", size)
    hosts = _shares(seen, "host", size)
    joined = seen.join(suffixes, "suffix", "left").join(hosts, "host", "left").join(F.broadcast(words), "declared", "left")
    zero = F.array(*[F.lit(0.0)] * size)
    of = lambda column, i: F.coalesce(F.col(column), zero)[i]
    total = lambda column: reduce(lambda a, b: a + b, [of(column, i) for i in range(size)])
    score = []
    for i in range(size):
        parent = (of("n_suffix", i) + F.lit(SMOOTHING * float(base[i]))) / (total("n_suffix") + SMOOTHING)
        prior = (of("n_host", i) + SMOOTHING * parent) / (total("n_host") + SMOOTHING)
        score.append(F.col("logs")[i] + of("told", i) + F.log(parent / F.lit(float(base[i]))) * F.lit(0.5) + F.log(prior))
    best = F.array(*score)
    posterior = F.expr("1 / aggregate(score, 0D, (a, s) -> a + exp(s - array_max(score)))")
    return (
        joined.withColumn("score", best)
        .withColumn("posterior", F.round(posterior, 6))
        .withColumn("lang", F.element_at(F.array(*map(F.lit, [*languages, None])).cast("array<string>"), F.expr("int(array_position(score, array_max(score)))")))
        .withColumn("kept", (F.col("n_trigrams") > 0) & F.col("lang").isNotNull() & (F.col("posterior") >= min_posterior))
        .select("rid", "lang", "posterior", "n_trigrams", "kept")
    )


def identify_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    declared: Column | None = None,
    host: Column | None = None,
    keep: list[str] | None = None,
) -> DataFrame:
    """owner (the id), rid and the columns of ``identify`` for every row.

    ``declared``: the language the markup declares (``markup_language``), by default ``lang``;
    ``host``: of the address (``url_filter.url_host_path``), by default ``source``. Repeated rows and
    null ids are rows of their own. An empty table gives an empty result.
    """
    declared = F.col("lang") if declared is None else declared
    host = F.col("source") if host is None else host
    inner = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), declared.alias("_declared"), host.alias("_host"), *(keep or []))
    rows = row_keyed(inner, "_id", "_text", ["_declared", "_host", *(keep or [])])
    address = F.nullif(F.col("_host").cast("string"), F.lit(""))
    told = rows.select("rid", "text", F.col("_declared").cast("string").alias("declared"), address.alias("host"))
    found = identify(told.withColumn("suffix", address_suffix(F.col("host"))))
    return rows.select("rid", "owner", *(keep or [])).join(found, "rid")


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents whose language is found, columns as they are but ``lang``, which is the language found.

    Columns may have any names. Rows are judged each for itself: ids may be null or repeat. Null, empty and
    blank texts have no letters and go. An empty table gives an empty result.
    """
    rows = docs.withColumn("_row", F.struct(*[F.col(f"`{c}`") for c in docs.columns]))
    found = identify_documents(rows, keep=["_row"]).filter("kept")
    columns = [F.col("lang") if c == "lang" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns]
    return found.select(*columns)
