"""Classification over a stream: running totals, event-time windows, tagging."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tracelight.operators import classify as C
from tracelight.operators.detect import detect_messages
from tracelight.operators.tagging import tag_catalog
from tracelight.session import shared_folder

# One row for each type of a field; the row without a type holds the messages of a topic.
_NO_TYPE = ""
RUNNING = (
    "topic string, field_path string, pii_type string, type_count long, confidence_sum double, messages long, "
    "sample_values array<string>"
)


class FieldStatistics(StatefulProcessor):
    """State of one field of a topic: counts per type, and the ten smallest values found.

    Both are bounded: there are twenty types, and values beyond the tenth are let go. After each batch
    that touches the field, one row per type tells all there is of it.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._types = handle.getMapState("types", "pii_type string", "type_count long, confidence_sum double, messages long")
        self._samples = handle.getValueState("samples", "sample_values array<string>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        types = {k[0]: tuple(v) for k, v in self._types.iterator()}
        samples = set(self._samples.get()[0]) if self._samples.exists() else set()
        changed = set()
        for row in rows:
            before = types.get(row.pii_type, (0, 0.0, 0))
            types[row.pii_type] = (before[0] + row.type_count, before[1] + row.confidence_sum, before[2] + row.messages)
            changed.add(row.pii_type)
            samples.update(row.sample_values)
        for name in changed:
            self._types.updateValue((name,), types[name])
        smallest = sorted(samples)[: C.MAX_SAMPLES]
        self._samples.update((smallest,))
        for name, (n, confidence, messages) in sorted(types.items()):
            yield Row(
                topic=key[0], field_path=key[1], pii_type=name, type_count=n, confidence_sum=confidence,
                messages=messages, sample_values=smallest,
            )

    def close(self) -> None:
        pass


def running_statistics(stream: DataFrame, enabled: list[str] | None = None) -> DataFrame:
    """Statistics of all fields as a stream in update mode; the totals live in Spark's state store.

    Each batch gives the fields that it touched, and the message counts of its topics, as they are
    after it. ``running_state`` reads all of them from the checkpoint. Messages without a topic, and
    findings without a path, are left out, as in the batch classification.
    """
    found = detect_messages(stream, enabled).select(
        "topic", "field_path", "pii_type", F.lit(1).cast("long").alias("n"), F.col("confidence").alias("confidence_sum"),
        (F.col("hit_no") == 1).cast("long").alias("messages"), "value",
    )
    one = F.lit(1).cast("long")
    seen = stream.select(
        "topic", F.lit(_NO_TYPE).alias("field_path"), F.lit(_NO_TYPE).alias("pii_type"), one.alias("n"),
        F.lit(0.0).alias("confidence_sum"), one.alias("messages"), F.lit(None).cast("string").alias("value"),
    )
    parts = C.partial_statistics(found.unionByName(seen))  # so a hot field sends few rows to its one key
    return parts.groupBy("topic", "field_path").transformWithState(FieldStatistics(), RUNNING, "update", "none")


def running_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """All statistics after the last finished batch, from the state of the query with that checkpoint."""
    # (types and values are two variables of one state)
    state = spark.read.format("statestore").option("path", checkpoint)
    types = state.option("stateVarName", "types").load().select(
        "key.topic", "key.field_path", F.col("user_map_key.pii_type").alias("pii_type"), "user_map_value.*"
    )
    samples = state.option("stateVarName", "samples").load().select("key.topic", "key.field_path", "value.sample_values")
    return types.join(samples, ["topic", "field_path"], "left").select(*[c.split()[0] for c in RUNNING.split(", ")])


def message_totals(rows: DataFrame) -> DataFrame:
    """Messages per topic out of running statistics."""
    return rows.where(F.col("pii_type") == _NO_TYPE).select("topic", F.col("type_count").alias("total_samples"))


def classify_running(rows: DataFrame, thresholds: C.Thresholds = C.Thresholds()) -> DataFrame:
    """Classifications out of running statistics: the state, or what one batch gave."""
    stats = rows.where(F.col("pii_type") != _NO_TYPE)
    counts = stats.withColumn("type_confidence", F.col("confidence_sum") / F.col("type_count"))
    return C.classify_counts(counts, message_totals(rows), thresholds)


class StreamTagger:
    """``foreachBatch`` sink of ``running_statistics`` that tags the schema catalog.

    A batch classifies the fields that it touched, by all that was seen of them so far. The catalog
    gets a new version only where the annotation text changes, so a repeated batch adds nothing.
    """

    def __init__(self, catalog_path: str, thresholds: C.Thresholds = C.Thresholds()):
        self.catalog_path, self.thresholds = catalog_path, thresholds

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        shared_folder(spark)
        # a few rows per touched field; fixed, as the statistics are read more than once
        cls = classify_running(batch.checkpoint(), self.thresholds)
        _, appended = tag_catalog(spark.read.parquet(self.catalog_path), cls, only_changes=True)
        # A few rows per changed schema; fixed before the append, as it reads the same folder.
        appended.checkpoint().write.mode("append").parquet(self.catalog_path)


def _in_window(msgs: DataFrame, interval: str) -> DataFrame:
    return msgs.withColumn("window", F.window("timestamp", interval))


def monitor_stream(
    stream: DataFrame, interval: str = "1 hour", delay: str = "10 minutes", enabled: list[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Statistics per event-time window, as two streams: counts per found value and message totals.

    Both are append-mode aggregates that emit a window once the watermark has passed it; store
    them and give them to ``classify_closed``. The key of the counts holds the value, so the state of
    a hot field is spread over all tasks, and a window's values leave the state when it closes.
    """
    windowed = _in_window(stream.withWatermark("timestamp", delay), interval)
    det = detect_messages(windowed, enabled, keep=["window"])
    counts = det.groupBy("window", "topic", "field_path", "pii_type", "value").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("confidence").alias("confidence_sum"),
        F.sum((F.col("hit_no") == 1).cast("long")).alias("messages"),
    )
    totals = windowed.groupBy("window", "topic").agg(F.count(F.lit(1)).alias("total_samples"))
    return (
        counts.withColumn("window_start", F.col("window.start")).drop("window"),
        totals.withColumn("window_start", F.col("window.start")).drop("window"),
    )


_SLOT = ["topic", "window_start"]


def classify_closed(counts: DataFrame, totals: DataFrame, thresholds: C.Thresholds = C.Thresholds()) -> DataFrame:
    """Classifications per closed window from the stored statistics of ``monitor_stream``."""
    return C.classify_counts(C.statistics(counts, _SLOT), totals, thresholds, _SLOT)


def classify_windows(
    msgs: DataFrame,
    interval: str = "1 hour",
    thresholds: C.Thresholds = C.Thresholds(),
    enabled: list[str] | None = None,
) -> DataFrame:
    """Classifications per event-time window of a message table."""
    slotted = _in_window(msgs, interval).withColumn("window_start", F.col("window.start"))
    totals = slotted.groupBy(*_SLOT).agg(F.count(F.lit(1)).alias("total_samples"))
    return C.classify_fields(detect_messages(slotted, enabled, keep=["window_start"]), totals, thresholds, _SLOT)
