"""Detection over field rows: pattern findings, dedupe, conflict rules, type filter."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelight.functions import patterns, records
from tracelight.functions.resolve import keep_types, resolve
from tracelight.operators.fields import MESSAGE_KEY, flatten, parse_json_lenient
from tracelight.schemas import CORE_TYPES, DETECTION, PRIORITY, TYPE_NAMES


def screened(fields: DataFrame) -> DataFrame:
    """Field rows whose value, stripped, may hold a finding."""
    rows = fields.withColumn("value", F.expr(patterns.strip("value")))
    return rows.where(patterns.may_hold_pii("field_path", "value"))


def _with_hits(fields: DataFrame, null_as_text: bool, keep: Sequence[str], screen: bool = True) -> DataFrame:
    value = "coalesce(value, 'None')" if null_as_text else "value"
    rows = fields.select(*MESSAGE_KEY, "field_path", F.expr(patterns.strip(value)).alias("value"), *keep)
    if screen:
        rows = rows.where(patterns.may_hold_pii("field_path", "value"))
    return rows.withColumn("hits", F.expr(patterns.pattern_hits("field_path", "value")))


def _unnest(rows: DataFrame, hits: str, keep: Sequence[str]) -> DataFrame:
    # posexplode_outer, not inline: for a non-outer generator Catalyst adds a size() > 0 filter
    # and copies the whole array expression into it.
    out = rows.select(
        *MESSAGE_KEY, "field_path", "value", *keep, F.posexplode_outer(hits).alias("pos", "hit")
    ).where(F.col("hit").isNotNull())
    return out.select(
        *MESSAGE_KEY,
        "field_path",
        F.col("hit.pii_type").alias("pii_type"),
        F.col("hit.confidence").alias("confidence"),
        "value",
        F.col("hit.pattern_matched").alias("pattern_matched"),
        F.col("hit.provider").alias("provider"),
        (F.col("pos") + 1).alias("hit_no"),
        *keep,
    )


def detect_pattern(fields: DataFrame, null_as_text: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """Raw pattern and field-name findings, before conflict rules. Narrow: no shuffle."""
    return _unnest(_with_hits(fields, null_as_text, keep), "hits", keep)


def detect_fields(
    fields: DataFrame,
    enabled: list[str] | None = None,
    null_as_text: bool = False,
    keep: Sequence[str] = (),
    screen: bool = True,
) -> DataFrame:
    """Resolved findings of the built-in patterns, one row per finding. Narrow: no shuffle.

    ``enabled`` defaults to the ten core types; an empty list gives no rows. ``keep`` names further
    columns to carry along. ``screen=False`` is for field rows that are ``screened`` already, and only saves time.
    """
    enabled = CORE_TYPES if enabled is None else enabled
    hits = _with_hits(fields, null_as_text, keep, screen)
    kept = keep_types(resolve("hits", "field_path", "value", "value"), enabled)
    return _unnest(hits.withColumn("kept", F.expr(kept)), "kept", keep)


def value_findings(fields: DataFrame, enabled: list[str] | None = None, screen: bool = True) -> DataFrame:
    """Resolved findings per distinct value of a field, with how often it occurs.

    A finding depends on the field path and the value only. Values that may hold one are counted
    first, equal ones already within their task, and the patterns run on distinct values only. The
    result is what ``classify.statistics`` sums up. ``screen=False`` is for field rows that are
    ``screened`` already, and only saves time.
    """
    enabled = CORE_TYPES if enabled is None else enabled
    rows = fields.select("topic", "field_path", F.expr(patterns.strip("value")).alias("value"))
    if screen:
        rows = rows.where(patterns.may_hold_pii("field_path", "value"))
    values = (
        rows.where("topic is not null and field_path is not null")
        .groupBy("topic", "field_path", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    kept = keep_types(resolve("hits", "field_path", "value", "value"), enabled)
    found = values.withColumn("hits", F.expr(patterns.pattern_hits("field_path", "value"))).withColumn(
        "kept", F.expr(kept)
    )
    return (
        found.select("topic", "field_path", "value", "n", F.posexplode_outer("kept").alias("pos", "hit"))
        .where(F.col("hit").isNotNull())
        .select(
            "topic",
            "field_path",
            "value",
            F.col("hit.pii_type").alias("pii_type"),
            "n",
            (F.col("hit.confidence") * F.col("n")).alias("confidence_sum"),
            F.when(F.col("pos") == 0, F.col("n")).otherwise(0).alias("messages"),
        )
    )


def detect_messages(
    msgs: DataFrame, enabled: list[str] | None = None, keep: Sequence[str] = ()
) -> DataFrame:
    """JSON messages to resolved findings: parse, flatten, detect. Works on streams as well."""
    # A message without a record has no leaves.
    return detect_fields(flatten(parse_json_lenient(msgs), keep), enabled, keep=keep)


def message_types(msgs: DataFrame, enabled: list[str] | None = None) -> DataFrame:
    """Each message with ``pii_types``, the sorted set of types found in it.

    All of it happens inside the row, so on a stream it needs no state.
    """
    enabled = CORE_TYPES if enabled is None else enabled

    # transform over a one-element array gives an expression a name, so it is evaluated once.
    types = f"transform({keep_types(resolve('hits', 'l.path', 'value', 'value'), enabled)}, k -> k.pii_type)"
    hits = f"if({patterns.may_hold_pii('l.path', 'value')}, {patterns.pattern_hits('l.path', 'value')}, array())"
    per_hits = f"flatten(transform(array({hits}), hits -> {types}))"
    value = patterns.strip("cast(l.node as string)")
    per_value = f"flatten(transform(array({value}), value -> coalesce({per_hits}, array())))"
    scalars = "filter(leaves, l -> try_cast(l.node as array<variant>) is null)"
    parsed = parse_json_lenient(msgs).where(F.col("json").isNotNull())
    leaves = parsed.withColumn("leaves", F.expr(records.entries(expand_nested_lists=False)))
    return leaves.select(
        *MESSAGE_KEY,
        F.expr(f"array_sort(array_distinct(flatten(transform({scalars}, l -> {per_value}))))").alias("pii_types"),
    )


def priority_of(pii_type: Column) -> Column:
    """Conflict priority of a type."""
    lookup = F.expr("map(" + ", ".join(f"'{t}', {p}" for t, p in PRIORITY.items()) + ")")
    return F.coalesce(F.element_at(lookup, pii_type), F.lit(0))


def _detection_order(findings: DataFrame) -> Column:
    """Order of findings within one field: provider first, then the order in its own list."""
    parts = [F.col("provider_no") if "provider_no" in findings.columns else F.lit(0)]
    if "seq" in findings.columns:
        parts.append(F.col("seq"))
    else:
        ordinals = ", ".join(f"'{t}'" for t in TYPE_NAMES)
        parts.append(F.expr(f"cast(array_position(array({ordinals}), pii_type) as int)"))
    return (parts[0] * 1000 + parts[1]).cast("int")


def dedupe(findings: DataFrame) -> DataFrame:
    """One finding per field, type and value: the most confident, the earliest among equals."""
    order = _detection_order(findings)
    key = [*MESSAGE_KEY, "field_path", "pii_type", "value"]
    field_value = F.col("field_value") if "field_value" in findings.columns else F.col("value")
    best = F.struct(
        F.col("confidence"), (-order).alias("earliest"), F.col("pattern_matched"), F.col("provider")
    )
    # max over a struct is a plain partial aggregate; no window and no sort of whole groups.
    return (
        findings.groupBy(*key)
        .agg(F.max(best).alias("best"), F.min(order).alias("seq"), F.max(field_value).alias("field_value"))
        .select(*key, "best.confidence", "best.pattern_matched", "best.provider", "seq", "field_value")
    )


def resolve_findings(findings: DataFrame, enabled: list[str] | None = None) -> DataFrame:
    """Dedupe, conflict rules and type filter for findings of any providers.

    Rules only compare findings with the same value of the same field in the same message, so a
    group holds at most one entry per type.
    """
    enabled = CORE_TYPES if enabled is None else enabled
    unique = dedupe(findings)
    hit = F.struct(
        "seq",
        "pii_type",
        "confidence",
        priority_of(F.col("pii_type")).alias("priority"),
        "pattern_matched",
        "provider",
    )
    groups = unique.groupBy(*MESSAGE_KEY, "field_path", "value").agg(
        F.array_sort(F.collect_list(hit)).alias("hits"),
        F.max("field_value").alias("field_value"),
    )
    kept = keep_types(resolve("hits", "field_path", patterns.strip("field_value"), "value"), enabled)
    rows = groups.withColumn("kept", F.expr(kept))
    out = rows.select(
        *MESSAGE_KEY, "field_path", "value", F.explode_outer("kept").alias("hit")
    ).where(F.col("hit").isNotNull())
    return number_hits(
        out.select(
            *MESSAGE_KEY,
            "field_path",
            F.col("hit.pii_type").alias("pii_type"),
            F.col("hit.confidence").alias("confidence"),
            "value",
            F.col("hit.pattern_matched").alias("pattern_matched"),
            F.col("hit.provider").alias("provider"),
            F.col("hit.seq").alias("seq"),
        )
    )


def number_hits(findings: DataFrame) -> DataFrame:
    """Add ``hit_no`` so that exactly one finding of each field of each message carries 1.

    All other findings carry 2. Groups are single fields of single messages.
    """
    order = F.struct(F.col("seq") if "seq" in findings.columns else F.lit(0), "pii_type", "value")
    key = [*MESSAGE_KEY, "field_path"]
    marked = findings.withColumn("place", order)
    first = F.min("place").over(Window.partitionBy(*key))
    return marked.withColumn("hit_no", F.when(F.col("place") == first, 1).otherwise(2)).select(
        *DETECTION.fieldNames()
    )


def filter_enabled(findings: DataFrame, enabled: list[str]) -> DataFrame:
    """Only findings of the enabled types."""
    return findings.where(F.col("pii_type").isin(*enabled)) if enabled else findings.limit(0)
