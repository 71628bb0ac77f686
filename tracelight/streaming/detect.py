"""Continuous detection: stateless projections, dead letters, offsets, statistics."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracelight.operators.detect import detect_messages, message_types
from tracelight.operators.fields import parse_json_lenient
from tracelight.schemas import MESSAGE_SCHEMA


def read_stream(
    spark: SparkSession,
    path: str | None = None,
    fmt: str = "parquet",
    starting_position: str = "latest",
    per_trigger: int | None = None,
    bytes_per_trigger: int | None = None,
    since: datetime | None = None,
    **options: str,
) -> DataFrame:
    """Messages as a stream, from files or (where deployed) from Kafka.

    ``starting_position`` is ``latest`` or ``earliest``. For files ``latest`` leaves out what was written before
    ``since`` (a time with a zone), by default the time of this call; a restart names the first start, or it would leave out
    what came in between. ``per_trigger`` bounds what one commit covers: offsets for Kafka, files otherwise;
    ``bytes_per_trigger`` bounds it by the size of the files.
    """
    if starting_position not in ("latest", "earliest"):
        raise ValueError("starting_position must be latest or earliest")
    if since is not None and since.tzinfo is None:
        raise ValueError("since needs a time zone")
    reader = spark.readStream.format(fmt).options(**options)
    if fmt == "kafka":
        reader = reader.option("startingOffsets", starting_position)
        if per_trigger:
            reader = reader.option("maxOffsetsPerTrigger", per_trigger)
        return reader.load()
    reader = reader.schema(MESSAGE_SCHEMA)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    if bytes_per_trigger:
        reader = reader.option("maxBytesPerTrigger", bytes_per_trigger)
    msgs = reader.load(path)
    if starting_position == "earliest":
        return msgs
    start = F.timestamp_micros(F.lit(int((since or datetime.now(timezone.utc)).timestamp() * 1_000_000)))
    return msgs.where(F.col("_metadata.file_modification_time") >= start)


def stream_detect(stream: DataFrame, enabled: list[str] | None = None) -> DataFrame:
    """Resolved findings of each message; what is no JSON record is skipped. Stateless."""
    return detect_messages(stream, enabled)


def stream_message_types(stream: DataFrame, enabled: list[str] | None = None) -> DataFrame:
    """Messages that hold sensitive values, with the set of their types. Stateless."""
    return message_types(stream, enabled).where(F.size("pii_types") > 0)


def dead_letters(msgs: DataFrame) -> DataFrame:
    """Non-empty messages that hold no JSON record, for a sink of their own."""
    parsed = parse_json_lenient(msgs)
    return parsed.where(F.col("json").isNull() & (F.length("value") > 0)).drop("json", "record", "levels")


def stream_stats(msgs: DataFrame) -> DataFrame:
    """Processed and failed messages per topic; on a stream use update or complete mode."""
    failed = F.col("json").isNull() & (F.coalesce(F.length("value"), F.lit(0)) > 0)
    return (
        parse_json_lenient(msgs)
        .groupBy("topic")
        .agg(
            F.sum((~failed).cast("long")).alias("processed"),
            F.sum(failed.cast("long")).alias("errors"),
        )
    )


def next_offsets(msgs: DataFrame) -> DataFrame:
    """The next offset to read of each topic and partition."""
    return msgs.groupBy("topic", "partition").agg((F.max("offset") + 1).alias("next_offset"))


def resume(msgs: DataFrame, offsets: DataFrame) -> DataFrame:
    """Messages not read yet according to an offset table; unknown partitions are read whole.

    The table has one row per partition; AQE broadcasts it by its measured size.
    """
    return (
        msgs.join(offsets, ["topic", "partition"], "left")
        .where(F.col("offset") >= F.coalesce("next_offset", F.lit(0)))
        .select(*msgs.columns)
    )


def write_stream(
    df: DataFrame, path: str, checkpoint: str, once: bool = True, interval: str = "10 seconds"
) -> StreamingQuery:
    """Append a stream to Parquet; ``once`` handles what is there and stops.

    The checkpoint holds the offsets, so a restart with the same checkpoint resumes.
    """
    writer = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    writer = writer.outputMode("append")
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)
    return writer.start()
