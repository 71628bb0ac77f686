"""Message tables: reading, producing, topic discovery and profiles."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelight.operators.ordering import RANGES, dense_offsets, integer_key
from tracelight.operators.skew import skew_join
from tracelight.schemas import MESSAGE_SCHEMA

# Topics left out of discovery unless other patterns are given.
DEFAULT_EXCLUDES = ["^_", "__consumer_offsets", "__transaction_state"]


def read_messages(
    spark: SparkSession,
    path: str | None = None,
    topics: list[str] | None = None,
    fmt: str = "parquet",
    **options: str,
) -> DataFrame:
    """Messages of the chosen topics from a Parquet/ORC/JSON table, or ``fmt="kafka"`` where that
    package is deployed. The topic filter reaches the scan (and prunes a topic-partitioned table).
    """
    if fmt == "kafka":
        reader = spark.read.format("kafka").options(**options)
        reader = reader.option("subscribe", ",".join(topics)) if topics else reader.option("subscribePattern", ".*")
        return reader.load()
    reader = spark.read.options(**options).format(fmt)
    if fmt != "parquet":
        reader = reader.schema(MESSAGE_SCHEMA)
    msgs = reader.load(path)
    return msgs.where(F.col("topic").isin(*topics)) if topics else msgs


def write_messages(msgs: DataFrame, path: str, mode: str = "append") -> None:
    """Store messages by topic, so later reads of a few topics skip the other folders."""
    msgs.write.mode(mode).partitionBy("topic").parquet(path)


def to_messages(
    df: DataFrame,
    topic: str,
    key: str,
    n_partitions: int = 3,
    timestamp: str | None = None,
    value: Column | None = None,
    ranges: int = RANGES,
) -> DataFrame:
    """Rows of a table as JSON messages of a topic.

    The unique integer ``key`` decides the partition (``key`` modulo ``n_partitions``) and the
    order of offsets within it; offsets are dense however sparse the keys are.
    """
    body = value if value is not None else F.to_json(F.struct("*"))
    stamp = F.col(timestamp) if timestamp else F.lit(None)
    rows = df.select(
        F.pmod(F.col(key), F.lit(n_partitions)).cast("int").alias("partition"),
        integer_key(df, F.col(key)).alias("_k"),
        F.col(key).cast("string").cast("binary").alias("key"),
        body.cast("binary").alias("value"),
        stamp.cast("timestamp").alias("timestamp"),
    )
    numbered = dense_offsets(rows, F.col("partition"), F.col("_k"), "offset", ranges)
    headers = F.lit(None).cast(MESSAGE_SCHEMA["headers"].dataType)
    return numbered.select(
        F.lit(topic).alias("topic"), "partition", "offset", "key", "value", "timestamp",
        headers.alias("headers"),
    )


def list_topics(msgs: DataFrame, pattern: str | None = None) -> DataFrame:
    """Distinct topic names; the pattern is anchored at the start only."""
    topics = msgs.select("topic").distinct()
    return topics.where(F.col("topic").rlike(f"^(?:{pattern})")) if pattern else topics


def _excluded(name: Column, patterns: list[str]) -> Column:
    hit = F.lit(False)
    for pattern in patterns:
        try:
            re.compile(pattern)
            hit = hit | name.rlike(pattern)
        except re.error:
            hit = hit | name.contains(pattern)
    return hit


def resolve_topics(
    msgs: DataFrame,
    requested: list[str] | None = None,
    configured: list[str] | None = None,
    exclude_patterns: list[str] | None = None,
    all_topics: bool = False,
) -> DataFrame:
    """Topics to analyse: requested names, else configured names, else all that are not excluded.

    Exclude patterns may match anywhere; one that is no valid regex is taken as plain text.
    """
    spark = msgs.sparkSession
    names = requested or (configured if configured and not all_topics else None)
    if names:
        return spark.createDataFrame([(n,) for n in names], "topic string")
    return list_topics(msgs).where(~_excluded(F.col("topic"), exclude_patterns or DEFAULT_EXCLUDES))


def exclude_listed(topics: DataFrame, excluded: DataFrame) -> DataFrame:
    """Topics that are not in a table of excluded names (for lists too long for patterns)."""
    return topics.join(excluded.select("topic").distinct(), "topic", "left_anti")


def partition_profile(msgs: DataFrame) -> DataFrame:
    """First offset, next offset and message count of each partition."""
    return msgs.groupBy("topic", "partition").agg(
        F.min("offset").alias("low"),
        (F.max("offset") + 1).alias("high"),
        F.count(F.lit(1)).alias("message_count"),
    )


def topic_profile(msgs: DataFrame) -> DataFrame:
    """Partition count, message count and largest partition of each topic."""
    return (
        partition_profile(msgs)
        .groupBy("topic")
        .agg(
            F.count(F.lit(1)).alias("partitions"),
            F.sum("message_count").alias("message_count"),
            F.max("message_count").alias("largest_partition"),
        )
    )


def topic_totals(msgs: DataFrame) -> DataFrame:
    """Messages per topic, the denominator of detection rates; reads the topic column only."""
    return msgs.groupBy("topic").agg(F.count(F.lit(1)).alias("total_samples"))


def empty_topics(topic_catalog: DataFrame, msgs: DataFrame) -> DataFrame:
    """Each catalogued topic with ``is_empty``: no partition holds a message."""
    held = partition_profile(msgs).groupBy("topic").agg(
        F.max((F.col("low") < F.col("high")).cast("int")).alias("held")
    )
    return topic_catalog.select("topic").distinct().join(held, "topic", "left").select(
        "topic", (F.coalesce("held", F.lit(0)) == 0).alias("is_empty")
    )


def flag_schemaless(topics: DataFrame, catalog: DataFrame) -> DataFrame:
    """Each topic, or each message, with ``schemaless``: the catalog holds no subject ``<topic>-value``."""
    subjects = catalog.select("subject").distinct().withColumn("known", F.lit(True))
    named = topics.withColumn("subject", F.concat("topic", F.lit("-value")))
    return skew_join(named, subjects, ["subject"], "left").select(
        *topics.columns, F.col("known").isNull().alias("schemaless")
    )
