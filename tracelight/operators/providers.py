"""Findings of other detectors: mapping, span slicing, model prompts and answers, registry.

Remote services are not called here. Their findings and answers arrive as tables; the work around
them (what to ask, how to read the answer, how to merge it) is done on the cluster.
"""

from __future__ import annotations

import threading
import warnings
from collections.abc import Callable, Iterable, Iterator
from typing import Protocol, runtime_checkable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelight.operators.detect import _detection_order, detect_pattern, resolve_findings
from tracelight.operators.fields import MESSAGE_KEY
from tracelight.operators.skew import skew_join, stored_side
from tracelight.schemas import CORE_TYPES, DETECTION, TYPE_NAMES

# Entity names of each provider and the type they stand for.
PROVIDER_ENTITIES = {
    "presidio": {
        "PERSON": "NAME",
        "EMAIL_ADDRESS": "EMAIL",
        "PHONE_NUMBER": "PHONE_NUMBER",
        "IP_ADDRESS": "IP_ADDRESS",
        "LOCATION": "ADDRESS",
        "CREDIT_CARD": "CREDIT_CARD",
        "SSN": "SSN",
        "US_DRIVER_LICENSE": "DRIVER_LICENSE",
        "US_PASSPORT": "PASSPORT",
        "DATE_TIME": "DATE_OF_BIRTH",
        "IBAN_CODE": "IBAN",
        "SWIFT_CODE": "SWIFT_CODE",
        "US_BANK_NUMBER": "BANK_ACCOUNT",
        "UK_NHS": "NATIONAL_INSURANCE_NUMBER",
    },
    "aws": {
        "SSN": "SSN",
        "EMAIL": "EMAIL",
        "PHONE": "PHONE_NUMBER",
        "IP_ADDRESS": "IP_ADDRESS",
        "ADDRESS": "ADDRESS",
        "CREDIT_DEBIT_NUMBER": "CREDIT_CARD",
        "DATE_TIME": "DATE_OF_BIRTH",
        "PERSON": "NAME",
        "DRIVER_ID": "DRIVER_LICENSE",
        "PASSPORT_NUMBER": "PASSPORT",
        "BANK_ACCOUNT_NUMBER": "BANK_ACCOUNT",
        "IBAN": "IBAN",
        "SWIFT_CODE": "SWIFT_CODE",
        "AWS_ACCESS_KEY": "AWS_ACCESS_KEY",
        "AWS_SECRET_KEY": "AWS_SECRET_KEY",
        "ITIN": "ITIN",
        "UK_NATIONAL_INSURANCE_NUMBER": "NATIONAL_INSURANCE_NUMBER",
        "USERNAME": "USERNAME",
        "PASSWORD": "PASSWORD",
        "MAC_ADDRESS": "MAC_ADDRESS",
    },
    "gcp": {
        "US_SOCIAL_SECURITY_NUMBER": "SSN",
        "EMAIL_ADDRESS": "EMAIL",
        "PHONE_NUMBER": "PHONE_NUMBER",
        "IP_ADDRESS": "IP_ADDRESS",
        "STREET_ADDRESS": "ADDRESS",
        "CREDIT_CARD_NUMBER": "CREDIT_CARD",
        "DATE_OF_BIRTH": "DATE_OF_BIRTH",
        "PERSON_NAME": "NAME",
        "US_DRIVERS_LICENSE_NUMBER": "DRIVER_LICENSE",
        "PASSPORT": "PASSPORT",
        "US_BANK_ACCOUNT_NUMBER": "BANK_ACCOUNT",
        "IBAN_CODE": "IBAN",
        "SWIFT_CODE": "SWIFT_CODE",
        "AWS_ACCESS_KEY_ID": "AWS_ACCESS_KEY",
        "AWS_SECRET_ACCESS_KEY": "AWS_SECRET_KEY",
        "US_INDIVIDUAL_TAXPAYER_IDENTIFICATION_NUMBER": "ITIN",
        "UK_NATIONAL_INSURANCE_NUMBER": "NATIONAL_INSURANCE_NUMBER",
        "USERNAME": "USERNAME",
        "PASSWORD": "PASSWORD",
        "MAC_ADDRESS_LOCAL": "MAC_ADDRESS",
    },
    "azure": {
        "USSocialSecurityNumber": "SSN",
        "Email": "EMAIL",
        "PhoneNumber": "PHONE_NUMBER",
        "IPAddress": "IP_ADDRESS",
        "Address": "ADDRESS",
        "CreditCardNumber": "CREDIT_CARD",
        "Date": "DATE_OF_BIRTH",
        "Person": "NAME",
        "USDriversLicenseNumber": "DRIVER_LICENSE",
        "PassportNumber": "PASSPORT",
        "BankAccountNumber": "BANK_ACCOUNT",
        "IBAN": "IBAN",
        "SWIFTCode": "SWIFT_CODE",
        "ITIN": "ITIN",
        "UKNationalInsuranceNumber": "NATIONAL_INSURANCE_NUMBER",
        "Username": "USERNAME",
        "Password": "PASSWORD",
        "MACAddress": "MAC_ADDRESS",
    },
    "model": {
        "ssn": "SSN",
        "social_security": "SSN",
        "social_security_number": "SSN",
        "email": "EMAIL",
        "email_address": "EMAIL",
        "phone": "PHONE_NUMBER",
        "phone_number": "PHONE_NUMBER",
        "telephone": "PHONE_NUMBER",
        "address": "ADDRESS",
        "street_address": "ADDRESS",
        "credit_card": "CREDIT_CARD",
        "credit card": "CREDIT_CARD",
        "card_number": "CREDIT_CARD",
        "name": "NAME",
        "person_name": "NAME",
        "full_name": "NAME",
        "date_of_birth": "DATE_OF_BIRTH",
        "dob": "DATE_OF_BIRTH",
        "birthday": "DATE_OF_BIRTH",
        "passport": "PASSPORT",
        "passport_number": "PASSPORT",
        "driver_license": "DRIVER_LICENSE",
        "drivers_license": "DRIVER_LICENSE",
        "license_number": "DRIVER_LICENSE",
        "ip_address": "IP_ADDRESS",
        "ip": "IP_ADDRESS",
        "bank_account": "BANK_ACCOUNT",
        "account_number": "BANK_ACCOUNT",
        "iban": "IBAN",
        "swift": "SWIFT_CODE",
        "swift_code": "SWIFT_CODE",
    },
}

# Likelihood words and their confidence; any other word means 0.5.
LIKELIHOOD = {
    "VERY_UNLIKELY": 0.1,
    "UNLIKELY": 0.3,
    "POSSIBLE": 0.5,
    "LIKELY": 0.7,
    "VERY_LIKELY": 0.9,
}

SCHEMA_VALUE = "[schema-based detection]"
VERIFIED_VALUE = "[value-verified detection]"


def _lookup(pairs: dict, key: Column) -> Column:
    return F.element_at(F.expr("map(" + ", ".join(f"'{k}', {v!r}" for k, v in pairs.items()) + ")"), key)


def entity_map(spark: SparkSession) -> DataFrame:
    """The (provider, entity, pii_type) dimension, about a hundred rows."""
    rows = [(p, e, t) for p, entities in PROVIDER_ENTITIES.items() for e, t in entities.items()]
    return spark.createDataFrame(rows, "provider string, entity string, pii_type string")


def normalize_findings(findings: DataFrame) -> DataFrame:
    """Provider entities as types; unknown entities are dropped.

    The dimension is a constant of this module, so broadcasting it has a fixed size.
    """
    dim = F.broadcast(entity_map(findings.sparkSession))
    return findings.join(dim, ["provider", "entity"]).drop("entity")


def likelihood_to_confidence(likelihood: Column) -> Column:
    """Confidence of a likelihood word."""
    return F.coalesce(_lookup(LIKELIHOOD, likelihood).cast("double"), F.lit(0.5))


def slice_spans(findings: DataFrame, text_col: str = "text") -> DataFrame:
    """``value`` and ``pattern_matched`` cut out of the analysed text by ``begin`` and ``end``."""
    begin = F.coalesce(F.col("begin"), F.lit(0))
    end = F.coalesce(F.col("end"), F.length(text_col))
    cut = F.substring(F.col(text_col), begin + 1, F.greatest(end - begin, F.lit(0)))
    return findings.withColumn("value", cut).withColumn("pattern_matched", cut)


def keep_whole_value_spans(findings: DataFrame) -> DataFrame:
    """For spans of the text ``<field>: <value>``: those that cover the value.

    Input has ``field_path``, ``field_value``, ``begin`` and ``end``; a span that covers the field
    name as well is cut back to the value.
    """
    text = F.concat("field_path", F.lit(": "), "field_value")
    span = F.substring(text, F.col("begin") + 1, F.col("end") - F.col("begin"))
    prefix = F.concat("field_path", F.lit(":"))
    inner = F.when(
        span.startswith(prefix), F.btrim(F.expr("substring(_span, length(field_path) + 2)"))
    ).otherwise(F.col("_span"))
    rows = findings.withColumn("_span", span).withColumn("pattern_matched", inner)
    covers = (F.col("pattern_matched") == F.col("field_value")) | F.col("_span").contains(F.col("field_value"))
    return rows.where(covers).withColumn("value", F.col("field_value")).drop("_span")


def uncovered_fields(fields: DataFrame, det: DataFrame) -> DataFrame:
    """Field paths without any finding."""
    return (
        fields.select("topic", "field_path").distinct()
        .join(det.select("topic", "field_path").distinct(), ["topic", "field_path"], "left_anti")
    )


# How much of the data a prompt shows.
PROMPT_RECORDS = 10
PROMPT_TEXT_LIMIT = 200
PROMPT_KEPT = 5
PROMPT_SHOWN = 3


def prompt_samples(fields: DataFrame, uncovered: DataFrame) -> DataFrame:
    """Uncovered fields of each topic with up to five short sample values.

    Only the first ten records of a topic that have an uncovered field are looked at. They are
    found by a rank that Spark turns into a group limit, so a huge topic sends ten keys per task. The uncovered
    fields, then the records, are stored and meet the field rows by ``skew_join``.
    """
    uncovered = stored_side(uncovered.select("topic", "field_path"), "uncovered")
    wanted = skew_join(fields, uncovered, ["topic", "field_path"], "left_semi")
    records = wanted.select(*MESSAGE_KEY)
    rank = F.dense_rank().over(Window.partitionBy("topic").orderBy("partition", "offset"))
    first = records.withColumn("record_no", rank).where(F.col("record_no") <= PROMPT_RECORDS).distinct()
    value = F.col("value")
    usable = value.isNotNull() & (value != "") & (F.length(value) < PROMPT_TEXT_LIMIT)
    samples = (
        skew_join(wanted.where(usable), first, MESSAGE_KEY)
        .groupBy("topic", "field_path")
        # At most ten records, hence ten values.
        .agg(F.slice(F.array_sort(F.collect_list(F.struct("record_no", "value"))), 1, PROMPT_KEPT).alias("s"))
    )
    return uncovered.join(samples, ["topic", "field_path"], "left").select(
        "topic", "field_path", F.coalesce(F.col("s.value"), F.array().cast("array<string>")).alias("sample_values")
    )


def build_schema_prompts(fields: DataFrame, uncovered: DataFrame) -> DataFrame:
    """One row per topic: its uncovered fields with up to three sample values each, as text.

    ``fields_text`` is the list a prompt template embeds; one request per topic, not per value.
    """
    shown = F.slice("sample_values", 1, PROMPT_SHOWN)
    line = F.when(
        F.size("sample_values") > 0,
        F.concat(F.lit("- "), "field_path", F.lit(": ["), F.array_join(shown, ", "), F.lit("]")),
    ).otherwise(F.concat(F.lit("- "), "field_path"))
    return (
        prompt_samples(fields, uncovered)
        .groupBy("topic")
        .agg(
            F.array_sort(F.collect_list(F.struct("field_path", line.alias("line")))).alias("lines"),
            F.count(F.lit(1)).alias("field_count"),
        )
        .select("topic", "field_count", F.array_join("lines.line", "\n").alias("fields_text"))
    )


def _unfenced(response: Column, openers: str) -> Column:
    """Content of the first JSON code fence, else the text itself."""
    trimmed = F.btrim(response, F.lit(" \t\r\n"))
    parts = F.transform(F.split(trimmed, "```"), lambda p: F.btrim(p, F.lit(" \t\r\n")))
    fenced = F.get(F.filter(parts, lambda p: p.rlike(f"^(json|[{openers}])")), F.lit(0))
    return F.when(
        trimmed.contains("```") & fenced.isNotNull(), F.regexp_replace(fenced, "^json", "")
    ).otherwise(trimmed)


def _between(text: Column, opener: str, closer: str) -> Column:
    return F.regexp_extract(text, rf"(?s)\{opener}.*\{closer}", 0)


def _model_type(name: Column) -> Column:
    """Type of a model's own wording: a type name, else one of the known aliases."""
    lowered = F.replace(F.lower(name), F.lit(" "), F.lit("_"))
    return F.when(F.upper(name).isin(*TYPE_NAMES), F.upper(name)).otherwise(
        _lookup(PROVIDER_ENTITIES["model"], lowered)
    )


def _clamped(confidence: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(confidence.try_cast("double"), F.lit(0.8))))


def parse_schema_response(responses: DataFrame, known_fields: DataFrame) -> DataFrame:
    """Schema-level answers (topic, response) as rows per field.

    Fields that do not exist and types that are not known are dropped; an answer without a JSON
    array gives no rows.
    """
    body = _between(_unfenced(F.col("response"), r"\[\{"), "[", "]")
    items = F.from_json(
        body, "array<struct<field:string,pii_type:string,confidence:string,reasoning:string>>"
    )
    rows = responses.select("topic", F.inline_outer(items)).where(F.col("field").isNotNull())
    confidence = _clamped(F.col("confidence"))
    return (
        rows.select(
            "topic",
            F.col("field").alias("field_path"),
            _model_type(F.col("pii_type")).alias("pii_type"),
            confidence.alias("confidence"),
            F.coalesce("reasoning", F.lit("")).alias("reasoning"),
            (confidence < 0.9).alias("needs_value_check"),
        )
        .where(F.col("pii_type").isNotNull())
        .join(known_fields.select("topic", "field_path").distinct(), ["topic", "field_path"], "left_semi")
    )


def parse_field_response(responses: DataFrame, provider: str = "model") -> DataFrame:
    """Per-value answers ``{"pii": …, "type": …, "confidence": …}`` as findings, none or one each."""
    body = _between(_unfenced(F.col("response"), r"\[\{"), "{", "}")
    answer = F.from_json(body, "struct<pii:boolean,type:string,confidence:string>")
    kind = _lookup(PROVIDER_ENTITIES["model"], F.replace(F.lower("a.type"), F.lit(" "), F.lit("_")))
    return (
        responses.withColumn("a", answer)
        .where(F.col("a.pii"))
        .select(
            *MESSAGE_KEY,
            "field_path",
            kind.alias("pii_type"),
            _clamped(F.col("a.confidence")).alias("confidence"),
            "value",
            F.lit(provider).alias("pattern_matched"),
            F.lit(provider).alias("provider"),
        )
        .where(F.col("pii_type").isNotNull())
    )


def eligible_values(fields: DataFrame, least: int = 3, most: int | None = None) -> DataFrame:
    """Values worth a per-value request: ``least`` characters or more, and ``most`` at most if given."""
    kept = fields.where(F.length("value") >= least)
    return kept if most is None else kept.where(F.length("value") <= most)


def verification_gate(analyses: DataFrame, verdicts: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    """Which schema-level analyses become findings.

    At 0.85 or above, or when no value check is needed, an analysis stands as it is. Otherwise a
    verdict must confirm it with more than 0.6, and the verdict's confidence counts. ``samples``
    (topic, field_path) are the fields with sample values; without one there is nothing to confirm.
    """
    said = verdicts.select(
        "topic", "field_path", "confirmed", F.coalesce("confidence", F.lit(0.5)).alias("verdict_confidence")
    )
    if samples is not None:
        said = said.join(samples.select("topic", "field_path").distinct(), ["topic", "field_path"], "left_semi")
    joined = analyses.where(F.col("pii_type").isNotNull()).join(said, ["topic", "field_path"], "left")
    direct = (F.col("confidence") >= 0.85) | ~F.coalesce("needs_value_check", F.lit(True))
    confirmed = F.coalesce("confirmed", F.lit(False)) & (F.col("verdict_confidence") > 0.6)
    return joined.where(direct | confirmed).select(
        "topic",
        "field_path",
        "pii_type",
        F.when(direct, F.col("confidence")).otherwise(F.col("verdict_confidence")).alias("confidence"),
        F.when(direct, SCHEMA_VALUE).otherwise(VERIFIED_VALUE).alias("value"),
        F.when(direct, "schema").otherwise("verified").alias("pattern_matched"),
    )


def spread_schema_findings(
    findings: DataFrame, fields: DataFrame, enabled: list[str] | None = None, provider: str = "model"
) -> DataFrame:
    """Attach each schema-level finding to every message that has the field.

    The small side is one row per field and type; ``skew_join`` measures it, and a field of very many
    messages is spread over tasks.
    """
    enabled = CORE_TYPES if enabled is None else enabled
    kept = findings.where(F.col("pii_type").isin(*enabled)) if enabled else findings.limit(0)
    order = Window.partitionBy("topic", "field_path").orderBy("pii_type", "value")
    numbered = kept.select(
        "topic", "field_path", "pii_type", "confidence", "value", "pattern_matched",
        F.lit(provider).alias("provider"), F.row_number().over(order).alias("hit_no"),
    )
    return skew_join(fields.select(*MESSAGE_KEY, "field_path"), numbered, ["topic", "field_path"]).select(
        *DETECTION.fieldNames()
    )


@runtime_checkable
class Provider(Protocol):
    """A per-field detector: field rows in, finding rows out, both as DataFrames."""

    def detect(self, fields: DataFrame) -> DataFrame: ...

    def is_available(self) -> bool: ...

    def supported_types(self) -> list[str]: ...


@runtime_checkable
class SchemaProvider(Protocol):
    """A schema-level detector: rows of ``build_schema_prompts`` in, analyses out."""

    def detect_in_schema(self, prompts: DataFrame) -> DataFrame: ...

    def is_available(self) -> bool: ...


class PatternProvider:
    """The built-in patterns as a provider."""

    def detect(self, fields: DataFrame) -> DataFrame:
        return detect_pattern(fields)

    def is_available(self) -> bool:
        return True

    def supported_types(self) -> list[str]:
        from tracelight.functions.patterns import SUPPORTED_TYPES

        return list(SUPPORTED_TYPES)


# Columns of a report: findings, and rows with ``error`` for values on which the detector raised.
REPORT = (
    "topic string, partition int, offset long, field_path string, pii_type string, confidence double,"
    "value string, pattern_matched string, provider string, error string"
)


def _attempt(detect_columns: Callable, paths, values, first: int = 0) -> Iterator[tuple]:
    """(row, type, confidence, matched, error) of a batch; one that fails is halved down to the failing values."""
    try:
        found = detect_columns(paths, values)
        rows = zip(found["row"], found["pii_type"], found["confidence"], found["pattern_matched"])
        out = [(first + int(row), kind, float(score), matched, None) for row, kind, score, matched in rows]
    except Exception as error:  # noqa: BLE001 - any failure of a foreign detector becomes a row
        if len(values) == 1:
            yield first, None, None, None, f"{type(error).__name__}: {error}"
            return
        half = len(values) // 2
        yield from _attempt(detect_columns, paths.iloc[:half], values.iloc[:half], first)
        rest = (part.iloc[half:].reset_index(drop=True) for part in (paths, values))
        yield from _attempt(detect_columns, *rest, first + half)
    else:
        yield from out


class ColumnProvider:
    """A Python detector of whole columns, for detectors that exist only as a Python library.

    ``detect_columns(paths, values)`` gets two pandas Series, the distinct pairs of an Arrow batch, and returns a frame
    of findings with ``row`` (position in the Series), ``pii_type``, ``confidence`` and ``pattern_matched``.

    A value on which the detector raises becomes an error row and the other values keep their
    findings. ``report`` holds both; ``detect`` gives the findings, ``errors`` the error rows.
    """

    def __init__(self, name: str, detect_columns: Callable, types: list[str]):
        self.name, self._detect_columns, self._types = name, detect_columns, types

    def report(self, fields: DataFrame) -> DataFrame:
        """Findings and error rows of one run; each pair of path and value of a batch is searched once."""
        name, detect_columns = self.name, self._detect_columns

        def run(batches: Iterator) -> Iterator:
            import pandas as pd

            for batch in batches:
                pairs = batch[["field_path", "value"]].drop_duplicates().reset_index(drop=True)
                if pairs.empty:
                    continue
                found = pd.DataFrame(
                    list(_attempt(detect_columns, pairs["field_path"], pairs["value"])),
                    columns=["pair", "pii_type", "confidence", "pattern_matched", "error"],
                )
                told = found.merge(pairs.assign(pair=pairs.index), on="pair").drop(columns="pair")
                # a batch merged with its own distinct pairs: as many rows as findings
                out = batch.assign(place=range(len(batch))).merge(told, on=["field_path", "value"])
                out = out.sort_values("place", kind="stable").assign(provider=name)
                yield out[[*MESSAGE_KEY, "field_path", "pii_type", "confidence", "value", "pattern_matched", "provider", "error"]]

        rows = fields.where(F.col("value").isNotNull()).select(*MESSAGE_KEY, "field_path", "value")
        return rows.mapInPandas(run, REPORT)

    def detect(self, fields: DataFrame) -> DataFrame:
        return self.report(fields).where("error is null").drop("error")

    def errors(self, fields: DataFrame) -> DataFrame:
        """(topic, field_path, error) of each value on which the detector raised."""
        return self.report(fields).where("error is not null").select("topic", "field_path", "error")

    def is_available(self) -> bool:
        return True

    def supported_types(self) -> list[str]:
        return list(self._types)


class RowProvider(ColumnProvider):
    """A Python detector ``(field_path, value) -> [(type, confidence, matched)]`` of single values.

    It is called for each distinct pair of a batch; where the detector can take columns, ``ColumnProvider``
    saves these calls.
    """

    def __init__(self, name: str, detect_value: Callable[[str, str], Iterable[tuple]], types: list[str]):
        def detect_columns(paths, values):
            import pandas as pd

            found = [
                (row, kind, score, matched)
                for row, (path, value) in enumerate(zip(paths, values))
                for kind, score, matched in detect_value(path, value)
            ]
            return pd.DataFrame(found, columns=["row", "pii_type", "confidence", "pattern_matched"])

        super().__init__(name, detect_columns, types)


# Second names, added when a provider is registered under the first.
PROVIDER_ALIASES = {
    "aws": ["comprehend"],
    "gcp": ["dlp"],
    "openai": ["chatgpt"],
    "anthropic": ["claude"],
}

_registry: dict[str, Callable[[], object]] = {}
_lock = threading.Lock()


def register_provider(name: str, factory: Callable[[], object], aliases: Iterable[str] = ()) -> None:
    """Make a provider known under a name (case does not matter) and further names."""
    probe = factory if isinstance(factory, type) else factory()
    if not (hasattr(probe, "detect") or hasattr(probe, "detect_in_schema")) or not hasattr(probe, "is_available"):
        raise ValueError("a provider needs is_available and detect or detect_in_schema")
    with _lock:
        for key in (name, *aliases, *PROVIDER_ALIASES.get(name.lower(), [])):
            _registry[key.lower()] = factory


def create_provider(name: str) -> object:
    """A provider by name."""
    with _lock:
        factory = _registry.get(name.lower())
        known = ", ".join(_registry)
    if factory is None:
        raise ValueError(f"unknown provider: {name}; known providers: {known}")
    return factory()


def available_providers() -> list[str]:
    """Names of all registered providers."""
    with _lock:
        return list(_registry)


register_provider("pattern", PatternProvider)

def active_providers(names: list[str] | None = None, use_pattern: bool = True) -> tuple[list, list]:
    """The available providers of a list as (per-field, schema-level).

    An unknown name is an error. Providers that cannot be made or are unavailable are left out with a warning.
    """
    names = list(names or ["pattern"])
    if use_pattern and "pattern" not in names:
        names.insert(0, "pattern")
    known = available_providers()
    if unknown := [n for n in names if n.lower() not in known]:
        raise ValueError(f"unknown providers: {unknown}; known providers: {known}")
    ready = []
    for name in names:
        try:
            provider = create_provider(name)
            if provider.is_available():
                ready.append((name, provider))
                continue
            reason = "it is not available"
        except Exception as error:
            reason = str(error)
        warnings.warn(f"provider {name} is left out: {reason}", stacklevel=2)
    if not ready:
        raise ValueError("no provider is available")
    schema_level = [(n, p) for n, p in ready if callable(getattr(p, "detect_in_schema", None))]
    per_field = [(n, p) for n, p in ready if (n, p) not in schema_level]
    return per_field, schema_level


def _merged(found: list[tuple[int, str, DataFrame]], enabled: list[str] | None) -> DataFrame:
    """Findings of several providers (place in the list, name, rows): deduplicated, resolved, filtered."""
    union = None
    for number, name, rows in found:
        if "provider" not in rows.columns:
            rows = rows.withColumn("provider", F.lit(name))
        # Findings get their place within the field before they are mixed with others.
        rows = rows.withColumn("provider_no", F.lit(number))
        if "hit_no" in rows.columns:
            rows = rows.withColumn("seq", F.col("hit_no")).drop("hit_no")
        rows = rows.withColumn("seq", _detection_order(rows)).drop("provider_no")
        union = rows if union is None else union.unionByName(rows, allowMissingColumns=True)
    if "field_value" in union.columns:
        union = union.withColumn("field_value", F.coalesce("field_value", "value"))
    return resolve_findings(union, enabled)


def detect_with(
    fields: DataFrame,
    providers: list[str] | None = None,
    enabled: list[str] | None = None,
    use_pattern: bool = True,
) -> DataFrame:
    """Findings of all per-field providers, deduplicated, resolved and filtered. Lazy; errors are not kept."""
    per_field, _ = active_providers(providers, use_pattern)
    found = []
    for number, (name, provider) in enumerate(per_field):
        try:
            found.append((number, name, provider.detect(fields)))
        except Exception as error:
            warnings.warn(f"provider {name} is left out: {error}", stacklevel=2)
    if not found:
        return fields.sparkSession.createDataFrame([], DETECTION)
    return _merged(found, enabled)


ERRORS = "topic string, provider string, error string, failures bigint"


def _failure(spark: SparkSession, name: str, error: Exception) -> DataFrame:
    """The error row of a provider that failed as a whole: no topic, one failure."""
    warnings.warn(f"provider {name} is left out: {error}", stacklevel=3)
    # Of an error of a task only the first line; the rest is its stack trace.
    text = f"{type(error).__name__}: {error}".strip().split("\n")[0]
    return spark.createDataFrame([(None, name, text, 1)], ERRORS)


def run_providers(
    fields: DataFrame,
    providers: list[str] | None = None,
    enabled: list[str] | None = None,
    use_pattern: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """(findings, errors) of all per-field providers.

    Findings are those of ``detect_with``; errors are topic, provider, error and on how many values
    (``failures``). A provider with a ``report`` runs now and once: the report is written to the shared folder and
    both results read it, so they fit together even if the detector is not deterministic. A provider that fails
    as a whole gives one error row without a topic, and the others go on.
    """
    spark = fields.sparkSession
    per_field, _ = active_providers(providers, use_pattern)
    found, errors = [], spark.createDataFrame([], ERRORS)
    for number, (name, provider) in enumerate(per_field):
        try:
            if callable(getattr(provider, "report", None)):
                report = stored_side(provider.report(fields), "report")
                failed = report.where("error is not null").groupBy("topic", F.lit(name).alias("provider"), "error")
                errors = errors.unionByName(failed.agg(F.count(F.lit(1)).alias("failures")))
                found.append((number, name, report.where("error is null").drop("error")))
            else:
                found.append((number, name, provider.detect(fields)))
        except Exception as error:  # noqa: BLE001 - any failure of a foreign provider becomes a row
            errors = errors.unionByName(_failure(spark, name, error))
    if not found:
        return spark.createDataFrame([], DETECTION), errors
    return _merged(found, enabled), errors


def detect_in_schemas(
    fields: DataFrame,
    detections: DataFrame,
    providers: list[tuple[str, SchemaProvider]],
    enabled: list[str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(findings, errors) of schema-level providers, given as (name, provider).

    They are asked about the fields without any of ``detections``, once per topic. What they say is
    attached to every message with that field. One that fails gives an error row without a topic.
    """
    spark = fields.sparkSession
    uncovered = stored_side(uncovered_fields(fields, detections), "uncovered")
    prompts = stored_side(build_schema_prompts(fields, uncovered), "prompts")
    found, errors = spark.createDataFrame([], DETECTION), spark.createDataFrame([], ERRORS)
    for name, provider in providers:
        try:
            answers = stored_side(provider.detect_in_schema(prompts), "answers")
            known = answers.join(uncovered, ["topic", "field_path"], "left_semi")
            found = found.unionByName(spread_schema_findings(known, fields, enabled, name))
        except Exception as error:  # noqa: BLE001 - any failure of a foreign provider becomes a row
            errors = errors.unionByName(_failure(spark, name, error))
    return found, errors
