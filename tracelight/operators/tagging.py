"""Schema tagging: annotations on Avro schemas in the catalog and on Spark schemas."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelight.functions.text import normalize_path
from tracelight.sources.catalog import latest_schema, new_versions


def normalize_classified_paths(cls: DataFrame) -> DataFrame:
    """Classifications with array positions removed from paths; the most confident per path stays."""
    paths = cls.withColumn("field_path", normalize_path(F.col("field_path")))
    row = F.struct(*[F.col(c) for c in cls.columns if c not in ("topic", "field_path")])
    best = paths.groupBy("topic", "field_path").agg(
        F.max_by(row, F.struct("confidence", "detection_count")).alias("row")
    )
    return best.select("topic", "field_path", "row.*").select(*cls.columns)


def doc_annotation(cls: DataFrame) -> DataFrame:
    """Add ``doc``: the types in order and the confidence to two places."""
    return cls.withColumn(
        "doc",
        F.concat(
            F.lit("PII: "),
            F.array_join(F.array_sort("pii_types"), ", "),
            F.lit(" (confidence: "),
            F.format_number("confidence", 2),
            F.lit(")"),
        ),
    )


def subject_metadata(cls: DataFrame) -> DataFrame:
    """Per subject: all tags, the classified fields, mean confidence and field count."""
    return (
        cls.groupBy("topic")
        .agg(
            # Bounded: at most one entry per tag of the type list and per field of a schema.
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("tags")))).alias("tags"),
            F.array_sort(F.collect_set("field_path")).alias("fields"),
            F.avg("confidence").alias("mean"),
            F.count(F.lit(1)).alias("fields_tagged"),
        )
        .select(
            F.concat("topic", F.lit("-value")).alias("subject"),
            "tags",
            F.array_join("fields", ",").alias("pii_fields"),
            F.format_number("mean", 2).alias("classification_confidence"),
            "fields_tagged",
            F.current_timestamp().alias("tagged_at"),
        )
    )


def _annotations(cls: DataFrame, topic: str) -> dict[str, dict]:
    """Classified paths of one topic; bounded by the number of fields of its schema."""
    rows = doc_annotation(normalize_classified_paths(cls.where(F.col("topic") == topic)))
    return {r["field_path"]: {"doc": r["doc"], "tags": list(r["tags"])} for r in rows.collect()}


def nested_paths(schema: T.StructType, prefix: str = "") -> list[str]:
    """Dotted paths of all fields, through structs, array items and map values."""
    out = []
    for field in schema.fields:
        path = f"{prefix}.{field.name}" if prefix else field.name
        out.append(path)
        inner = _element(field.dataType)
        if isinstance(inner, T.StructType):
            out.extend(nested_paths(inner, path))
    return out


def _element(kind: T.DataType) -> T.DataType:
    if isinstance(kind, T.ArrayType):
        return kind.elementType
    if isinstance(kind, T.MapType):
        return kind.valueType
    return kind


def annotate_schema(schema: T.StructType, found: dict[str, dict], prefix: str = "") -> tuple[T.StructType, int]:
    """A Spark schema with comments and tags on classified fields, and how many were set.

    The full dotted path is looked up first, then the bare field name.
    """
    fields, count = [], 0
    for field in schema.fields:
        path = f"{prefix}.{field.name}" if prefix else field.name
        note = found.get(path) or found.get(field.name)
        metadata = dict(field.metadata or {})
        if note:
            metadata.update({"comment": note["doc"], "pii.tags": note["tags"]})
            count += 1
        kind, inner = field.dataType, _element(field.dataType)
        if isinstance(inner, T.StructType):
            new, n = annotate_schema(inner, found, path)
            count += n
            if isinstance(kind, T.ArrayType):
                kind = T.ArrayType(new, kind.containsNull)
            elif isinstance(kind, T.MapType):
                kind = T.MapType(kind.keyType, new, kind.valueContainsNull)
            else:
                kind = new
        fields.append(T.StructField(field.name, kind, field.nullable, metadata))
    return T.StructType(fields), count


def tag_schema(df: DataFrame, cls: DataFrame, topic: str) -> tuple[DataFrame, int]:
    """A table whose schema carries the classifications as field metadata, and their number."""
    schema, count = annotate_schema(df.schema, _annotations(cls, topic))
    return df.to(schema), count


def path_matches(schema: T.StructType, cls: DataFrame, topic: str) -> DataFrame:
    """The classifications of a topic that meet a field of a schema, by path or bare name."""
    names = {p for path in nested_paths(schema) for p in (path, path.rsplit(".", 1)[-1])}
    paths = cls.sparkSession.createDataFrame([(n,) for n in sorted(names)], "field_path string")
    return normalize_classified_paths(cls.where(F.col("topic") == topic)).join(paths, "field_path", "left_semi")


def annotate_avro(schema: dict, docs: dict[str, str]) -> int:
    """Set ``doc`` on the classified fields of one Avro record schema in place; returns how many."""

    def records_in(kind) -> list[dict]:
        if isinstance(kind, list):
            return [r for branch in kind if isinstance(branch, dict) for r in records_in(branch)]
        if not isinstance(kind, dict):
            return []
        inner = {"record": kind, "array": kind.get("items"), "map": kind.get("values")}.get(kind.get("type"))
        return [inner] if isinstance(inner, dict) and inner.get("type") == "record" else []

    count, todo = 0, [("", schema)]
    while todo:
        prefix, record = todo.pop()
        for field in record.get("fields") or []:
            name = field.get("name", "")
            path = f"{prefix}.{name}" if prefix else name
            doc = docs.get(path) or docs.get(name)
            if doc is not None:
                field["doc"] = doc
                count += 1
            todo.extend((path, inner) for inner in records_in(field.get("type")))
    return count


_TAGGED = (
    "subject string, version int, schema_id int, schema_type string, old_schema string, "
    "schema string, fields_tagged int, error string"
)


def _tagged_schemas(catalog: DataFrame, cls: DataFrame) -> DataFrame:
    """Latest schema of every classified subject with the annotations written into it."""
    notes = doc_annotation(normalize_classified_paths(cls))
    per_subject = notes.groupBy(F.concat("topic", F.lit("-value")).alias("subject")).agg(
        # Bounded by the number of fields of one schema.
        F.map_from_entries(F.collect_list(F.struct("field_path", "doc"))).alias("docs")
    )
    current = latest_schema(catalog).select(
        "subject", "version", "schema_id", F.coalesce("schema_type", F.lit("AVRO")).alias("schema_type"), "schema"
    )

    def rewrite(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                new, count, error = row.schema, 0, None
                if row.schema is None or pd.isna(row.version):
                    error = f"no schema found for subject {row.subject}"
                else:
                    try:
                        parsed = json.loads(row.schema)
                        if not isinstance(parsed, dict) or parsed.get("fields") is None:
                            error = f"schema of {row.subject} has no fields"
                        else:
                            count = annotate_avro(parsed, dict(row.docs))
                            new = json.dumps(parsed)
                    except ValueError:
                        error = f"schema of {row.subject} is no valid JSON"
                version = None if pd.isna(row.version) else int(row.version)
                schema_id = None if pd.isna(row.schema_id) else int(row.schema_id)
                out.append((row.subject, version, schema_id, row.schema_type, row.schema, new, count, error))
            yield pd.DataFrame(
                out,
                columns=["subject", "version", "schema_id", "schema_type", "old_schema", "schema", "fields_tagged", "error"],
            ).astype({"version": "Int32", "schema_id": "Int32"})

    return per_subject.join(current, "subject", "left").mapInPandas(rewrite, _TAGGED)


def tag_catalog(
    catalog: DataFrame,
    cls: DataFrame,
    tag_format: str = "metadata",
    enabled: bool = True,
    backup_path: str | None = None,
    only_changes: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Tag the latest schema of every classified subject.

    Returns (log, appended): one log row per subject, and the catalog rows to append. Nothing is
    written here except backups, when a path is given. ``metadata`` also marks the subject metadata
    as applied; ``description`` only sets field docs; any other format is an error per subject.
    ``only_changes`` leaves out subjects whose annotations are already in place.
    """
    spark = catalog.sparkSession
    log_schema = (
        "subject string, success boolean, fields_tagged int, schema_version int, schema_id int, "
        "metadata_applied boolean, errors array<string>"
    )
    if not enabled:
        return spark.createDataFrame([], log_schema), catalog.limit(0)
    tagged = _tagged_schemas(catalog, cls)
    if tag_format not in ("metadata", "description"):
        bad = F.array(F.lit(f"unknown tag format: {tag_format}"))
        log = tagged.select(
            "subject", F.lit(False).alias("success"), F.lit(0).alias("fields_tagged"),
            F.lit(None).cast("int").alias("schema_version"), F.lit(None).cast("int").alias("schema_id"),
            F.lit(False).alias("metadata_applied"), bad.alias("errors"),
        )
        return log, catalog.limit(0)
    changed = tagged.where(F.col("error").isNull() & (F.col("fields_tagged") > 0))
    if only_changes:
        changed = changed.where(F.col("schema") != F.col("old_schema"))
    if backup_path:
        backup_versions(changed, backup_path)
    appended = new_versions(catalog, changed.select("subject", "schema", "schema_type"))
    new = appended.select("subject", F.col("version").alias("schema_version"), F.col("schema_id").alias("new_id"))
    log = tagged.join(new, "subject", "left").select(
        "subject",
        F.col("error").isNull().alias("success"),
        "fields_tagged",
        "schema_version",
        F.col("new_id").alias("schema_id"),
        (F.col("new_id").isNotNull() & F.lit(tag_format == "metadata")).alias("metadata_applied"),
        F.array_compact(F.array("error")).alias("errors"),
    )
    return log, appended


def backup_versions(changed: DataFrame, path: str) -> None:
    """Append the prior schema versions to a backup table partitioned by subject."""
    changed.select(
        "subject", "version", "schema_id", "schema_type",
        F.coalesce("old_schema", "schema").alias("schema") if "old_schema" in changed.columns else F.col("schema"),
        F.current_timestamp().alias("backed_up_at"),
    ).write.mode("append").partitionBy("subject").parquet(path)
