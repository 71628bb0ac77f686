"""The batch run: messages of any number of topics to classifications and summaries, as one plan."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelight.functions.text import normalize_path
from tracelight.operators import classify as C
from tracelight.operators import sampling
from tracelight.operators.detect import detect_fields
from tracelight.operators.fields import decode_records, extract_fields, fields_by_mode
from tracelight.operators.providers import ERRORS, active_providers, detect_in_schemas, run_providers
from tracelight.sources.messages import flag_schemaless, topic_totals


@dataclass
class RunResult:
    """Results of a run: lazy, but for the reports of Python and schema-level providers, which are stored."""

    fields: DataFrame
    detections: DataFrame
    classifications: DataFrame
    summary: DataFrame
    errors: DataFrame


@dataclass
class RunOptions:
    """What to sample, which types to look for, when a field counts.

    ``normalize_paths`` takes the positions out of array paths before fields are classified, so that
    all items of an array are one field. A message then counts once for the field, however many
    items it has.
    """

    strategy: str = "all"
    sampling: dict = field(default_factory=dict)
    max_partitions: int | None = None
    enabled: list[str] | None = None
    providers: list[str] | None = None
    thresholds: C.Thresholds = C.Thresholds()
    decoders: dict | None = None
    normalize_paths: bool = False


def field_rows(msgs: DataFrame, catalog: DataFrame | None = None, decoders: dict | None = None) -> DataFrame:
    """Field rows of all topics: schema mode where the catalog knows the topic, else schemaless."""
    decoded = decode_records(msgs, catalog, decoders, drop_empty=False)
    if catalog is None:
        return extract_fields(decoded)
    flagged = flag_schemaless(decoded, catalog)
    return fields_by_mode(flagged)


def analyze(
    msgs: DataFrame,
    topics: DataFrame | None = None,
    catalog: DataFrame | None = None,
    options: RunOptions | None = None,
) -> RunResult:
    """Sample, decode, detect, classify. ``topic`` is a grouping key, not a loop.

    Schema-level providers only see fields without a pattern finding; what they report is attached
    to every message with that field.
    """
    options = options or RunOptions()
    if options.max_partitions is not None:
        msgs = sampling.limit_partitions(msgs, options.max_partitions)
    sampled = sampling.sample(msgs, options.strategy, **options.sampling)
    totals = topic_totals(sampled)
    fields = field_rows(sampled, catalog, options.decoders)
    if options.normalize_paths:
        fields = fields.withColumn("field_path", normalize_path(F.col("field_path")))
    per_field, schema_level = active_providers(options.providers)
    if len(per_field) == 1 and per_field[0][0] == "pattern":
        det = detect_fields(fields, options.enabled)
        errors = fields.sparkSession.createDataFrame([], ERRORS)
    else:
        det, errors = run_providers(fields, [name for name, _ in per_field], options.enabled)
    if schema_level:
        more, failed = detect_in_schemas(fields, det, schema_level, options.enabled)
        det, errors = det.unionByName(more), errors.unionByName(failed)
    only_patterns = len(per_field) == 1 and per_field[0][0] == "pattern" and not schema_level
    if options.normalize_paths:
        # The numbers of findings hold for single items; without them one per message and field is counted.
        cls = C.classify_fields(det.drop("hit_no"), totals, options.thresholds)
    elif not only_patterns:
        cls = C.classify_fields(det, totals, options.thresholds)
    else:
        cls = C.classify_values(fields, totals, options.thresholds, options.enabled)
    return RunResult(fields, det, cls, C.topic_summary(cls, totals, topics, catalog), errors)
