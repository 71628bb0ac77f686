"""Findings to classified fields, and the roll-ups over classifications."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelight.operators.detect import value_findings
from tracelight.operators.fields import MESSAGE_KEY
from tracelight.schemas import HIGH_RISK, PII_TYPES, TYPE_NAMES, pii_types

MAX_SAMPLES = 10
# Fields of one task that are summed up before they are sent on.
_MOST_KEYS = 100_000
# Groups that the partial sums of a hot field are merged in first.
_SALTS = 64


@dataclass(frozen=True)
class Thresholds:
    """When a field counts as classified."""

    confidence: float = 0.7
    min_rate: float = 0.3
    require_multiple: bool = True


def _weighted(det: DataFrame, slot: Sequence[str]) -> DataFrame:
    """Findings with what each counts: itself, its confidence, and one message if it is the first of its field."""
    if "hit_no" not in det.columns:
        # Findings from outside: give one finding of each field and message the number 1.
        key = list(dict.fromkeys([*slot, *MESSAGE_KEY, "field_path"]))
        per_field = Window.partitionBy(*key).orderBy("pii_type", "value")
        det = det.withColumn("hit_no", F.row_number().over(per_field))
    return det.select(
        *slot,
        "field_path",
        "pii_type",
        "value",
        F.lit(1).cast("long").alias("n"),
        F.col("confidence").alias("confidence_sum"),
        (F.col("hit_no") == 1).cast("long").alias("messages"),
    )


def _summed(key: list[str]):
    """Per task: sums and the smallest values of each key, whatever the number of findings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        kinds: list[pa.DataType] = []

        def flush() -> pa.RecordBatch:
            columns = [pa.array(c, k) for c, k in zip(zip(*held), kinds)]
            sums = [pa.array(c) for c in zip(*(v[:3] for v in held.values()))]
            values = pa.array([sorted(v[3])[:MAX_SAMPLES] for v in held.values()], pa.list_(pa.string()))
            return pa.RecordBatch.from_arrays([*columns, *sums, values], names=[*key, *_SUMS, "sample_values"])

        for batch in batches:
            kinds = [batch.schema.field(k).type for k in key]
            sums = [(c, "sum") for c in ("n", "confidence_sum", "messages")]
            # sums of the batch in Arrow; Python only sees one row for each key of it
            table = pa.Table.from_batches([batch]).group_by(key).aggregate([*sums, ("value", "distinct")])
            names = [*key, "n_sum", "confidence_sum_sum", "messages_sum", "value_distinct"]
            for *own, n, confidence, messages, values in zip(*(table.column(c).to_pylist() for c in names)):
                now = held.setdefault(tuple(own), [0, 0.0, 0, set()])
                now[0] += n
                now[1] += confidence
                now[2] += messages
                # an empty value is found, but shows nothing
                now[3] = set(sorted({*now[3], *(v for v in values if v)})[:MAX_SAMPLES])
            if len(held) > _MOST_KEYS:
                yield flush()
                held.clear()
        if held:
            yield flush()

    return run


_SUMS = ("type_count", "confidence_sum", "messages")


def partial_statistics(rows: DataFrame, slot: Sequence[str] = ("topic",)) -> DataFrame:
    """Weighted findings (n, confidence_sum, messages, value) summed up within their task; see ``statistics``."""
    key = [*slot, "field_path", "pii_type"]
    known = rows.where(" and ".join(f"{k} is not null" for k in key)).select(*key, "value", "n", "confidence_sum", "messages")
    kinds = ", ".join(f"{k} {known.schema[k].dataType.simpleString()}" for k in key)
    return known.mapInArrow(
        _summed(key), f"{kinds}, type_count long, confidence_sum double, messages long, sample_values array<string>"
    )


def _smallest(lists: str) -> Column:
    return F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list(lists)))), 1, MAX_SAMPLES).alias("sample_values")


def statistics(rows: DataFrame, slot: Sequence[str] = ("topic",)) -> DataFrame:
    """Per field and type: findings, sum and mean of confidence, messages, and the ten smallest values.

    All in one pass: weighted findings are summed up in their task, then in salted groups, then per
    type. What is sent on has one row for each type of a field that a task has seen, with ten values
    at most, so a field that holds most findings costs no more than any other. ``slot`` names the
    columns that keep results apart: the topic, or topic and window.
    """
    key = [*slot, "field_path", "pii_type"]
    parts = partial_statistics(rows, slot).withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(_SALTS)))
    sums = [F.sum(c).alias(c) for c in _SUMS]
    merged = parts.groupBy(*key, "_salt").agg(*sums, _smallest("sample_values"))
    return merged.groupBy(*key).agg(*sums, _smallest("sample_values")).withColumn(
        "type_confidence", F.col("confidence_sum") / F.col("type_count")
    )


def type_stats(det: DataFrame) -> DataFrame:
    """Count and mean confidence of each type in each field."""
    return statistics(_weighted(det, ["topic"])).select("topic", "field_path", "pii_type", "type_count", "type_confidence")


def detection_counts(det: DataFrame, totals: DataFrame) -> DataFrame:
    """Messages with a finding in each field, and their share of all messages of the topic."""
    fields = statistics(_weighted(det, ["topic"])).groupBy("topic", "field_path").agg(F.sum("messages").alias("detection_count"))
    return _with_rate(fields, totals, ["topic"])


def _with_rate(fields: DataFrame, totals: DataFrame, slot: Sequence[str]) -> DataFrame:
    rate = F.when(
        F.col("total_samples") > 0,
        F.least(F.lit(1.0), F.col("detection_count") / F.col("total_samples")),
    ).otherwise(0.0)
    return fields.join(totals, list(slot)).withColumn("detection_rate", rate)


def sample_values(det: DataFrame) -> DataFrame:
    """Up to ten distinct detected values of each field, the smallest ones in order."""
    found = statistics(_weighted(det, ["topic"])).groupBy("topic", "field_path").agg(_smallest("sample_values"))
    return found.where(F.size("sample_values") > 0)


def _type_list() -> str:
    return "array(" + ", ".join(f"'{t}'" for t in TYPE_NAMES) + ")"


def tags_of(types: str) -> Column:
    """``PII`` and the tags of the types, each once, in type order."""
    pairs = ", ".join(
        f"'{name}', array({', '.join(repr(t) for t in tags)})" for name, _, _, tags in PII_TYPES
    )
    return F.expr(
        f"array_distinct(concat(array('PII'), flatten(transform({types}, t -> element_at(map({pairs}), t)))))"
    )


def classify_fields(
    det: DataFrame, totals: DataFrame, thresholds: Thresholds = Thresholds(), slot: Sequence[str] = ("topic",)
) -> DataFrame:
    """One row per field whose findings pass the thresholds (all bounds inclusive).

    ``totals`` gives the sampled messages per topic, undecodable ones included. The detection rate
    counts messages with any finding in the field; the confidence bound applies per type.
    """
    return classify_counts(statistics(_weighted(det, slot), slot), totals, thresholds, slot)


def classify_values(
    fields: DataFrame,
    totals: DataFrame,
    thresholds: Thresholds = Thresholds(),
    enabled: list[str] | None = None,
    screen: bool = True,
) -> DataFrame:
    """``classify_fields`` straight from field rows, for the built-in patterns.

    Values that may hold a finding are counted first; each distinct value is searched once and
    weighted by its count. ``screen=False``: see ``value_findings``.
    """
    return classify_counts(statistics(value_findings(fields, enabled, screen)), totals, thresholds)


def classify_counts(
    stats: DataFrame, totals: DataFrame, thresholds: Thresholds = Thresholds(), slot: Sequence[str] = ("topic",)
) -> DataFrame:
    """The thresholds applied to ``statistics``, also to those that a caller keeps over time."""
    # Means of sums of decimal fractions: compare without the last bits of the float sum.
    accepted = F.round("type_confidence", 9) >= thresholds.confidence
    ordinal = F.expr(f"array_position({_type_list()}, pii_type)")
    valid = F.when(accepted, F.struct(ordinal.alias("o"), F.col("pii_type").alias("t")))
    fields = stats.groupBy(*slot, "field_path").agg(
        F.sum("messages").alias("detection_count"),
        F.avg(F.when(accepted, F.col("type_confidence"))).alias("confidence"),
        # At most one entry per type.
        F.array_sort(F.collect_list(valid)).alias("valid"),
        _smallest("sample_values"),
    )
    wanted = (F.size("valid") > 0) & (F.col("detection_rate") >= thresholds.min_rate)
    if thresholds.require_multiple:
        wanted = wanted & (F.col("detection_count") >= 2)
    return _with_rate(fields, totals, slot).where(wanted).select(
        *slot,
        "field_path",
        F.col("valid.t").alias("pii_types"),
        tags_of("valid.t").alias("tags"),
        "confidence",
        "detection_count",
        "total_samples",
        "detection_rate",
        "sample_values",
    )


def topic_summary(
    cls: DataFrame, totals: DataFrame, topics: DataFrame | None = None, catalog: DataFrame | None = None
) -> DataFrame:
    """Samples, classified fields and flags of every topic, those without any findings included."""
    names = totals.select("topic") if topics is None else topics.select("topic").distinct()
    found = cls.groupBy("topic").agg(
        F.count(F.lit(1)).alias("fields_classified"),
        F.sum((F.size("pii_types") > 0).cast("long")).alias("pii_fields_found"),
    )
    rows = names.join(totals, "topic", "left").join(found, "topic", "left").select(
        "topic",
        F.coalesce("total_samples", F.lit(0)).alias("samples"),
        F.coalesce("fields_classified", F.lit(0)).alias("fields_classified"),
        F.coalesce("pii_fields_found", F.lit(0)).alias("pii_fields_found"),
    )
    if catalog is None:
        rows = rows.withColumn("schemaless", F.lit(False))
    else:
        from tracelight.sources.messages import flag_schemaless

        rows = flag_schemaless(rows, catalog)
    empty = F.col("samples") == 0
    # An empty topic is reported before its schema is looked up.
    return rows.withColumn("schemaless", F.col("schemaless") & ~empty).withColumn("empty", empty)


def run_summary(summary: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """Counters of a whole run; topics with an error row are no analysed topics."""
    good = summary
    n_errors = F.lit(0).cast("long")
    if errors is not None:
        good = summary.join(errors.select("topic").distinct(), "topic", "left_anti")
        n_errors = errors.agg(F.count(F.lit(1))).scalar()
    return good.agg(
        F.count(F.lit(1)).alias("topics_analyzed"),
        F.coalesce(F.sum("fields_classified"), F.lit(0)).alias("total_fields_classified"),
        F.coalesce(F.sum("pii_fields_found"), F.lit(0)).alias("total_pii_fields"),
        F.sum(F.col("empty").cast("long")).alias("empty_topics"),
    ).withColumn("errors", n_errors)


def triage_topics(summary: DataFrame) -> DataFrame:
    """Each topic as ``pii``, ``data_no_pii`` or ``empty``."""
    kind = (
        F.when(F.col("pii_fields_found") > 0, "pii")
        .when(F.col("samples") > 0, "data_no_pii")
        .otherwise("empty")
    )
    return summary.select("topic", kind.alias("triage"), "samples", "pii_fields_found")


def tags_summary(cls: DataFrame) -> DataFrame:
    """Fields per tag and per type, and the number of classified fields (``kind`` = ``total``)."""
    labels = F.concat(
        F.array(F.struct(F.lit("total").alias("kind"), F.lit("fields").alias("label"))),
        F.transform("tags", lambda t: F.struct(F.lit("tag").alias("kind"), t.alias("label"))),
        F.transform("pii_types", lambda t: F.struct(F.lit("type").alias("kind"), t.alias("label"))),
    )
    return cls.select(F.inline(labels)).groupBy("kind", "label").agg(F.count(F.lit(1)).alias("fields"))


def detection_summary(det: DataFrame, records: DataFrame | None = None, by: list[str] | None = None) -> DataFrame:
    """Per record (or any key): found or not, types, highest confidence, high risk, count.

    With ``records`` every record gets a row, those without findings an empty one.
    """
    by = by or MESSAGE_KEY
    found = det.groupBy(*by).agg(
        F.array_sort(F.collect_set("pii_type")).alias("pii_types"),
        F.max("confidence").alias("max_confidence"),
        F.bool_or(F.col("pii_type").isin(*HIGH_RISK)).alias("high_risk"),
        F.count(F.lit(1)).alias("detection_count"),
    )
    rows = found if records is None else records.select(*by).distinct().join(found, by, "left")
    return rows.select(
        *by,
        F.col("detection_count").isNotNull().alias("pii_detected"),
        F.coalesce("pii_types", F.array().cast("array<string>")).alias("pii_types"),
        F.coalesce("max_confidence", F.lit(0.0)).alias("max_confidence"),
        F.coalesce("high_risk", F.lit(False)).alias("high_risk"),
        F.coalesce("detection_count", F.lit(0)).alias("detection_count"),
    )


def high_risk(det: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Whether a record holds a high-risk type; only records with findings."""
    return det.groupBy(*(by or MESSAGE_KEY)).agg(
        F.bool_or(F.col("pii_type").isin(*HIGH_RISK)).alias("high_risk")
    )


def risk_rollup(cls: DataFrame) -> DataFrame:
    """Classified (field, type) pairs by topic and risk level, with subtotals."""
    dim = F.broadcast(pii_types(cls.sparkSession).select("pii_type", "risk_level"))
    rows = cls.select("topic", F.explode("pii_types").alias("pii_type")).join(dim, "pii_type")
    return rows.rollup("topic", "risk_level").agg(
        F.grouping_id().alias("level"), F.count(F.lit(1)).alias("fields")
    )


def classification_metrics(run_log: DataFrame) -> DataFrame:
    """Counters over all logged runs: runs, topics analysed, PII fields found, last run time."""
    return run_log.agg(
        F.count(F.lit(1)).alias("runs"),
        F.sum("topics_analyzed").alias("topics_analyzed"),
        F.sum("total_pii_fields").alias("pii_fields_found"),
        F.max("finished_at").alias("last_run"),
    )
