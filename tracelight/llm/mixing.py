"""Document rates that bring a corpus to target domain weights (soft-membership mixing).

A classifier fitted on the labelled documents gives each document a posterior over the domains. The
expected tokens of a domain are the sum over documents of rate * tokens * posterior. Rates, none negative,
whose expected domain tokens match the targets are found by distributed projected-gradient least squares.
"""

from __future__ import annotations

import warnings
from functools import reduce
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelight.llm.tables import row_keyed, stored

#: Domains by label: toxic documents, else by quality 0 or 1.
DOMAINS = ("poor", "good", "toxic")
#: Share of the tokens that each domain shall have.
TARGETS = (0.12, 0.85, 0.03)
BUCKETS = 8192
#: Labelled documents that the classifier is fitted on, at most; chosen by hash of the id.
LABELLED_SAMPLE = 200_000
#: Words that the distribution over all domains counts for in each domain's.
SMOOTHING = 20_000.0
#: Words that count in full as evidence; longer texts weigh as much as this many.
EVIDENCE = 60.0
#: Largest miss of a domain, as a share of the goal's tokens, with which the targets count as met.
TOLERANCE = 1e-4
#: Share of a full step below which a step is given up, and least fall of the miss, as a share of it, with which
#: descent goes on.
SHORTEST_STEP, LEAST_PROGRESS = 1e-4, 1e-6


def _words(rows: DataFrame, *keep: str) -> DataFrame:
    word = F.explode(F.split("text", r"[\x20\x09-\x0D]+")).alias("word")
    return rows.select(*keep, word).filter("word <> ''").select(
        *keep, F.pmod(F.xxhash64("word"), F.lit(BUCKETS)).cast("int").alias("bucket")
    )


def fit_domains(rows: DataFrame, labels: DataFrame, n: int = len(DOMAINS)) -> tuple[DataFrame, list[float]] | None:
    """For each word bucket the log probability in each domain (``l0``, ``l1``, ...), and the domains' log priors.

    A domain's counts are smoothed towards those of all domains. At most ``BUCKETS`` rows. None if no document is labelled. Labels with nulls are not used; of
    several labels of one document the greatest counts.
    """
    domain = F.when(F.col("toxic") == 1, n - 1).when(F.col("toxic") == 0, F.col("quality")).cast("int")
    known = (
        labels.select(F.col("doc_id").alias("owner"), domain.alias("domain"))
        .filter(f"owner is not null and domain between 0 and {n - 1}")
        .groupBy("owner")
        .agg(F.max("domain").alias("domain"))
        .orderBy(F.xxhash64("owner"), "owner")
        .limit(LABELLED_SAMPLE)
    )
    labelled = rows.join(F.broadcast(known), "owner")
    counts = stored(
        _words(labelled, "domain").groupBy("bucket").agg(
            *[F.count_if(F.col("domain") == k).alias(f"n{k}") for k in range(n)]
        ),
        "buckets",
    )
    total = counts.agg(*[F.coalesce(F.sum(f"n{k}"), F.lit(0)) for k in range(n)]).first()
    if not sum(total):
        return None
    seen = reduce(lambda a, b: a + b, [F.coalesce(f"n{k}", F.lit(0)) for k in range(n)])
    overall = (seen + 1) / F.lit(float(sum(total) + BUCKETS))
    logs = [
        F.log((F.coalesce(f"n{k}", F.lit(0)) + SMOOTHING * overall) / F.lit(float(total[k] + SMOOTHING))).alias(f"l{k}")
        for k in range(n)
    ]
    prior = [float(np.log((t + 1) / (sum(total) + n))) for t in total]
    every = rows.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    return every.join(counts, "bucket", "left").select("bucket", *logs), prior


def memberships(rows: DataFrame, model: tuple[DataFrame, list[float]] | None, n: int = len(DOMAINS)) -> DataFrame:
    """rid, tokens and posterior ``p0``, ``p1``, ... of each row of (rid, text); a uniform one without words or model."""
    words = _words(rows, "rid")
    if model is None:
        sums = words.groupBy("rid").agg(F.count("*").alias("tokens"), *[F.lit(0.0).alias(f"s{k}") for k in range(n)])
    else:
        sums = words.join(F.broadcast(model[0]), "bucket").groupBy("rid").agg(
            F.count("*").alias("tokens"), *[F.sum(f"l{k}").alias(f"s{k}") for k in range(n)]
        )
    weight = F.least(F.col("tokens"), F.lit(EVIDENCE)) / F.col("tokens")
    prior = model[1] if model else [0.0] * n
    scores = [F.col(f"s{k}") * weight + prior[k] for k in range(n)]
    top = F.greatest(*scores)
    share = [F.exp(s - top) for s in scores]
    total = reduce(lambda a, b: a + b, share)
    soft = sums.select("rid", "tokens", *[F.round(s / total, 6).alias(f"p{k}") for k, s in enumerate(share)])
    return rows.select("rid").join(soft, "rid", "left").select(
        "rid",
        F.coalesce("tokens", F.lit(0)).alias("tokens"),
        *[F.coalesce(f"p{k}", F.lit(1.0 / n)).alias(f"p{k}") for k in range(n)],
    )


class MixtureWarning(UserWarning):
    """The targets are out of reach of any rates found."""


class Fit(NamedTuple):
    """Rates, and each domain's expected and target tokens."""

    rates: DataFrame
    expected: np.ndarray
    goal: np.ndarray

    @property
    def met(self) -> bool:
        return bool(np.abs(self.expected - self.goal).max() <= TOLERANCE * self.goal.sum())


def solve_rates(soft: DataFrame, targets: tuple[float, ...] = TARGETS) -> Fit:
    """``soft`` (rid, tokens, p0, ...) with the column ``rate``, and what the rates bring about.

    The targets are shares of a total that leaves the domain of largest target its own tokens, so
    documents of that domain keep rates near 1. Projected gradient descent on the squared miss, from
    rate 1: each step takes from a document's rate its domain tokens times one weight per domain, and
    cuts at 0. The weights are the miss in the metric of the documents that still have a positive rate
    (their Gram matrix), and a step is halved until the miss falls. So a step needs only sums over all
    documents, and neither rates nor steps are bounded; descent ends once the targets are met, or once
    no step lowers the miss any more. Documents without tokens keep rate 1.
    """
    n = len(targets)
    part = [F.col("tokens") * F.col(f"p{k}") for k in range(n)]
    sums = soft.agg(
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("all"),
        *[F.sum(p).alias(f"t{k}") for k, p in enumerate(part)],
    ).first()
    whole = float(sums["all"])
    if not whole:
        return Fit(soft.withColumn("rate", F.lit(1.0)), np.zeros(n), np.zeros(n))
    share = np.array(targets) / sum(targets)
    # the total is what leaves the domain of largest target its own tokens
    first = int(share.argmax())
    goal = share * (sums[f"t{first}"] or whole) / share[first]

    def measured(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Expected tokens, and the Gram matrix of the documents of positive rate."""
        x = F.col("rate")
        pairs = [F.when(x > 0, part[i] * part[j]).otherwise(0.0) for i in range(n) for j in range(n)]
        got = rows.agg(*map(F.sum, [*[x * p for p in part], *pairs])).first()
        return np.array(got[:n], float), np.array(got[n:], float).reshape(n, n)

    rows = soft.withColumn("rate", F.lit(1.0))
    expected, gram = measured(rows)
    metric = _inverse(gram)
    miss = float((expected - goal) @ metric @ (expected - goal))
    # what no weights of the domains can change is not in this metric: where nothing else is left, descent ends too
    least = 1e-14 * float(goal @ metric @ goal)
    while np.abs(expected - goal).max() > TOLERANCE / 10 * goal.sum() and miss > least:
        slope, length = _inverse(gram) @ (expected - goal), 1.0
        while length > SHORTEST_STEP:
            less = reduce(lambda a, b: a + b, [p * float(length * w) for p, w in zip(part, slope, strict=True)])
            moved = rows.withColumn("rate", F.greatest(F.lit(0.0), F.col("rate") - less))
            there, gram_there = measured(moved)
            now = float((there - goal) @ metric @ (there - goal))
            if now <= miss * (1 - 1e-4 * length):
                break
            length /= 2
        else:  # no step lowers the miss: the targets are out of reach
            break
        rows = stored(moved, "rates")  # the next rates depend on these
        progress, miss, expected, gram = miss - now, now, there, gram_there
        if progress <= LEAST_PROGRESS * now:
            break
    return Fit(rows.withColumn("rate", F.round("rate", 6)), expected, goal)


def _inverse(gram: np.ndarray) -> np.ndarray:
    """Pseudo-inverse, in units in which each domain's tokens have length 1."""
    unit = np.sqrt(np.maximum(np.diag(gram), 1e-12))
    return np.linalg.pinv(gram / np.outer(unit, unit), rcond=1e-10) / np.outer(unit, unit)


def fit_rates(soft: DataFrame, targets: tuple[float, ...] = TARGETS) -> DataFrame:
    """``solve_rates``' rates; a ``MixtureWarning`` with expected and target tokens if the targets are not met."""
    fit = solve_rates(soft, targets)
    if not fit.met:
        told = ", ".join(f"{e:.0f} for {g:.0f}" for e, g in zip(fit.expected, fit.goal, strict=True))
        warnings.warn(f"mixture targets not met: expected tokens of each domain {told}", MixtureWarning, stacklevel=2)
    return fit.rates


def mix_documents(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    targets: tuple[float, ...] = TARGETS,
    keep: list[str] | None = None,
) -> DataFrame:
    """owner (the id), tokens, posterior p0, p1, ... and rate of every row, with the columns to ``keep``.

    Null and empty texts have no tokens, a uniform posterior and rate 1. Rows may repeat or have null
    ids. Without labelled documents all posteriors are uniform. An empty table gives an empty result.
    """
    n = len(targets)
    keyed = row_keyed(docs, id_col, text_col, keep)
    model = fit_domains(keyed.select("owner", "text"), labels, n)
    soft = stored(memberships(keyed.select("rid", "text"), model, n), "memberships")
    return keyed.select("rid", "owner", *(keep or [])).join(fit_rates(soft, targets), "rid").drop("rid")


def sample_mix(docs: DataFrame, labels: DataFrame, targets: tuple[float, ...] = TARGETS) -> DataFrame:
    """The documents, each as often as its rate says; columns as they are.

    The fraction of a rate is decided by a hash of the id, so a rerun decides alike; rows of one id, and
    rows of null id, share the coin. Columns may have any names. Null and empty texts have rate 1 and stay
    once. An empty table gives an empty result.
    """
    inner = docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    mixed = mix_documents(inner, labels, "_id", "_text", targets, ["_row"])
    coin = F.shiftrightunsigned(F.xxhash64("owner", F.lit("mix")), 11) / F.lit(float(1 << 53))
    times = F.floor("rate") + (coin < F.col("rate") - F.floor("rate")).cast("int")
    return (
        mixed.withColumn("_times", times)
        .filter("_times > 0")
        .select("_row", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int"))))
        .select("_row.*")
    )
