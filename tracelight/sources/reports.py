"""Report tables and the JSON report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelight.functions.text import mask

# What a report row shows.
REPORT_SAMPLES = 5
REPORT_TEXT = 50


def masked_samples(cls: DataFrame, include: bool = True) -> DataFrame:
    """Sample values masked except their last four characters, or none at all."""
    if include:
        samples = F.transform("sample_values", lambda v: mask(v, keep_last=4))
    else:
        samples = F.array().cast("array<string>")
    return cls.withColumn("sample_values", samples)


def report_rows(cls: DataFrame, include_samples: bool = True) -> DataFrame:
    """One display row per classified field: joined lists, rounded numbers, shortened samples."""
    rows = masked_samples(cls, include_samples)
    short = F.transform(
        F.slice("sample_values", 1, REPORT_SAMPLES),
        lambda v: F.when(F.length(v) > REPORT_TEXT, F.concat(F.left(v, F.lit(REPORT_TEXT - 3)), F.lit("..."))).otherwise(v),
    )
    extra = F.size("sample_values") - REPORT_SAMPLES
    more = F.when(extra > 0, F.format_string(" (+%d more)", extra)).otherwise("")
    return rows.select(
        "topic",
        "field_path",
        F.array_join("pii_types", ", ").alias("pii_types"),
        F.array_join("tags", " ").alias("tags"),
        F.format_number("confidence", 2).alias("confidence"),
        F.concat(F.format_number(F.col("detection_rate") * 100, 1), F.lit("%")).alias("detection_rate"),
        F.concat(F.array_join(short, ", "), more).alias("samples"),
    )


def topic_reports(summary: DataFrame, cls: DataFrame, include_samples: bool = True) -> DataFrame:
    """One nested row per topic: its counters and its classified fields."""
    fields = masked_samples(cls, include_samples).groupBy("topic").agg(
        # Bounded by the number of fields of one topic; samples are ten at most.
        F.array_sort(
            F.collect_list(
                F.struct("field_path", "pii_types", "tags", "confidence", "detection_rate", "sample_values")
            )
        ).alias("classifications")
    )
    return summary.join(fields, "topic", "left")


def write_report(
    summary: DataFrame,
    cls: DataFrame,
    path: str,
    fmt: str = "json",
    errors: DataFrame | None = None,
    include_samples: bool = True,
) -> str:
    """Write ``run`` (one summary row), ``topics`` and ``errors`` below a time-stamped folder."""
    from tracelight.operators.classify import run_summary

    if fmt not in ("json", "parquet"):
        raise ValueError(f"unknown report format: {fmt}")
    spark = summary.sparkSession
    stamp = spark.range(1).select(F.date_format(F.current_timestamp(), "yyyyMMdd_HHmmss")).first()[0]
    target = f"{path.rstrip('/')}/report_{stamp}"
    run = run_summary(summary, errors).withColumn("timestamp", F.current_timestamp())
    run.write.format(fmt).save(f"{target}/run")
    topic_reports(summary, cls, include_samples).write.format(fmt).save(f"{target}/topics")
    if errors is not None:
        errors.write.format(fmt).save(f"{target}/errors")
    return target
