"""Runs of consecutive failures per topic partition, the signal to stop a consumer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tracelight.operators.ordering import CHUNK

_PARTITION = ["topic", "partition"]


def failure_streaks(events: DataFrame, threshold: int = 100, chunk: int = CHUNK) -> DataFrame:
    """Runs of failures in offset order; ``tripped`` marks those that reach the threshold.

    ``events`` has topic, partition, offset and a boolean ``failed``; a success ends a run. A
    partition is cut into offset chunks that are searched independently. Only runs at the edge of a
    chunk, two per chunk at most, are then joined across chunks, so no task sorts a whole
    partition.
    """
    rows = events.select(
        *_PARTITION, "offset", "failed", F.expr(f"floor(offset / {int(chunk)})").alias("chunk")
    )
    inside = Window.partitionBy(*_PARTITION, "chunk")
    ordered = inside.orderBy("offset")
    marked = rows.select(
        "*",
        F.row_number().over(ordered).alias("place"),
        F.sum((~F.col("failed")).cast("long")).over(ordered).alias("run"),
        F.count(F.lit(1)).over(inside).alias("chunk_rows"),
    )
    runs = (
        marked.where("failed")
        .groupBy(*_PARTITION, "chunk", "run")
        .agg(
            F.min("offset").alias("start_offset"),
            F.max("offset").alias("end_offset"),
            F.count(F.lit(1)).alias("failures"),
            (F.min("place") == 1).alias("at_start"),
            (F.max("place") == F.max("chunk_rows")).alias("at_end"),
        )
    )
    edge = F.col("at_start") | F.col("at_end")
    # Chunks in order, one row each; a gap in the numbering would hide a chunk of successes.
    chunks = rows.groupBy(*_PARTITION, "chunk").agg(F.count(F.lit(1)).alias("rows")).select(
        *_PARTITION, "chunk", F.row_number().over(Window.partitionBy(*_PARTITION).orderBy("chunk")).alias("chunk_no")
    )
    by_chunk = Window.partitionBy(*_PARTITION).orderBy("chunk_no", "start_offset")
    continues = (
        F.col("at_start")
        & F.coalesce(F.lag("at_end").over(by_chunk), F.lit(False))
        & (F.coalesce(F.lag("chunk_no").over(by_chunk), F.lit(-1)) == F.col("chunk_no") - 1)
    )
    joined = (
        runs.where(edge)
        .join(chunks, [*_PARTITION, "chunk"])
        .withColumn("new", (~continues).cast("long"))
        .withColumn("streak", F.sum("new").over(by_chunk))
        .groupBy(*_PARTITION, "streak")
        .agg(
            F.min("start_offset").alias("start_offset"),
            F.max("end_offset").alias("end_offset"),
            F.sum("failures").alias("failures"),
        )
    )
    columns = [*_PARTITION, "start_offset", "end_offset", "failures"]
    return (
        runs.where(~edge).select(*columns).unionByName(joined.select(*columns))
        .withColumn("tripped", F.col("failures") >= threshold)
    )


def carry_streaks(state: DataFrame | None, batch: DataFrame) -> DataFrame:
    """New state per partition after one micro-batch of events.

    State has topic, partition, ``streak`` (failures since the last success), ``longest``. A batch
    changes it by three sums and bounds per partition, all plain aggregates: failures before its
    first success, failures after its last success, and its longest run.
    """
    success = F.when(~F.col("failed"), F.col("offset"))
    bounds = batch.groupBy(*_PARTITION).agg(F.min(success).alias("first_ok"), F.max(success).alias("last_ok"))
    runs = failure_streaks(batch).join(bounds, _PARTITION, "right")
    head = F.col("first_ok").isNull() | (F.col("end_offset") < F.col("first_ok"))
    tail = F.col("last_ok").isNull() | (F.col("start_offset") > F.col("last_ok"))
    parts = runs.groupBy(*_PARTITION).agg(
        F.coalesce(F.sum(F.when(head, F.col("failures"))), F.lit(0)).alias("head"),
        F.coalesce(F.sum(F.when(tail, F.col("failures"))), F.lit(0)).alias("tail"),
        F.coalesce(F.max("failures"), F.lit(0)).alias("best"),
        F.max(F.col("first_ok").isNotNull()).alias("any_ok"),
    )
    if state is None:
        carried = F.lit(0).cast("long")
        before = F.lit(0).cast("long")
        joined = parts
    else:
        known = state.select(*_PARTITION, F.col("streak").alias("carried"), F.col("longest").alias("before"))
        joined = parts.join(known, _PARTITION, "full")
        carried, before = F.coalesce("carried", F.lit(0)), F.coalesce("before", F.lit(0))
    none = F.lit(0)
    streak = F.when(F.col("any_ok"), F.col("tail")).otherwise(carried + F.coalesce("tail", none))
    longest = F.greatest(before, F.coalesce("best", none), carried + F.coalesce("head", none))
    return joined.select(*_PARTITION, streak.alias("streak"), longest.alias("longest"))


# An event on hold; ``failed`` is -1 where it is not known, which ends a run.
_EVENT = np.dtype([("offset", "<i8"), ("at", "<i8"), ("failed", "i1")])
# Events in one entry of the state; entries are read by hundreds.
_ENTRY = 1 << 14
# Events in the rows that carry the events of a key to the state, from the oldest on; the last size goes on.
_SIZES = [1] * 32 + [1 << n for n in range(1, 11)]


def _cuts(first: int, end: int) -> np.ndarray:
    """Where the rows begin that carry the events from ``first`` on, the oldest of them first, and ``end``."""
    small = first + np.cumsum([0, *_SIZES])
    return np.append(small[small < end], [*range(int(small[-1]) + _SIZES[-1], end, _SIZES[-1]), end])


def _carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Events of a topic partition in few rows, each with the latest of its events' timestamps.

    A stateful operator takes its rows one by one, which costs far more than what is done with an event.
    Its late rows are dropped whole, so the oldest events of a batch, which may be late, travel alone.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        topic, partition = (pc.dictionary_encode(batch.column(c), null_encoding="encode") for c in _PARTITION)
        key = topic.indices.to_numpy().astype("int64") * len(partition.dictionary) + partition.indices.to_numpy()
        time = batch.column("timestamp").cast(pa.int64()).to_numpy()
        order = np.lexsort((time, key))
        events = np.empty(len(order), _EVENT)
        events["offset"] = batch.column("offset").to_numpy()[order]
        events["at"] = time[order] // 1000
        events["failed"] = pc.fill_null(batch.column("failed").cast(pa.int8()), -1).to_numpy()[order]
        bounds = np.append(np.flatnonzero(np.diff(key[order], prepend=-1)), len(order))
        cuts = [_cuts(first, end) for first, end in zip(bounds[:-1], bounds[1:], strict=True)]
        begins, ends = np.concatenate([c[:-1] for c in cuts]), np.concatenate([c[1:] for c in cuts])
        keys = (batch.column(c).take(pa.array(order[begins])) for c in _PARTITION)
        latest = pa.array(time[order[ends - 1]]).cast(batch.column("timestamp").type)
        packed = pa.array([events[i:j].tobytes() for i, j in zip(begins, ends, strict=True)], pa.binary())
        yield pa.RecordBatch.from_arrays([*keys, latest, packed], names=[*_PARTITION, "timestamp", "packed"])


def _packed(events: np.ndarray) -> list[tuple[bytes]]:
    return [(events[i : i + _ENTRY].tobytes(),) for i in range(0, len(events), _ENTRY)]


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            events = np.frombuffer(row["packed"], _EVENT)
            failed = pa.array(events["failed"] == 1, mask=events["failed"] < 0)
            topic, partition = pa.array([row["topic"]], pa.string()), pa.array([row["partition"]], pa.int32())
            zeros = pa.array(np.zeros(len(events), "int64"))
            columns = [topic.take(zeros), partition.take(zeros), pa.array(events["offset"]), failed]
            yield pa.RecordBatch.from_arrays(columns, names=[*_PARTITION, "offset", "failed"])


class StreakStatistics(StatefulProcessor):
    """State of one topic partition: failures since its last success, the longest run, and events on hold.

    An event is held until the watermark has passed it; then all held events up to there are counted in
    the order of their offsets. So files and batches may come in any order within the watermark's delay.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._streak = handle.getValueState("streak", "streak long, longest long")
        # thousands of events in one entry: state is read and written by entries; a list would be one value
        self._held = handle.getMapState("held", "entry long", "packed binary")
        self._entries = handle.getValueState("entries", "next long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = None
        entry = self._entries.get()[0] if self._entries.exists() else 0
        for frame in rows:
            if not len(frame):
                continue
            events = np.frombuffer(b"".join(frame["packed"]), _EVENT)
            for packed in _packed(events):
                self._held.updateValue((entry,), packed)
                entry += 1
            last = max(int(events["at"].max()), last) if last is not None else int(events["at"].max())
        if last is not None:
            self._entries.update((entry,))
            self._handle.registerTimer(last + 1)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        offsets, failures, later = [], [], []
        for (entry,), (packed,) in self._held.iterator():
            events = np.frombuffer(packed, _EVENT)
            passed = events["at"] < mark
            if passed.any():
                offsets.append(events["offset"][passed])
                failures.append(events["failed"][passed])
                later.append((entry, events[~passed]))
        if not later:
            return
        offset, failed = np.concatenate(offsets), np.concatenate(failures)
        streak, longest = self._streak.get() if self._streak.exists() else (0, 0)
        failed = failed[np.lexsort((failed, offset))] == 1
        successes = np.flatnonzero(~failed)
        if len(successes):
            between = np.diff(successes) - 1
            ended = [streak + int(successes[0]), *([int(between.max())] if len(between) else [])]
            streak = len(failed) - 1 - int(successes[-1])
        else:
            ended = []
            streak += len(failed)
        longest = max(longest, streak, *ended)
        self._streak.update((streak, longest))
        for entry, rest in later:
            self._held.updateValue((entry,), (rest.tobytes(),)) if len(rest) else self._held.removeKey((entry,))
        yield pd.DataFrame({"topic": [key[0]], "partition": [key[1]], "streak": [streak], "longest": [longest]})

    def close(self) -> None:
        pass


def stream_streaks(events: DataFrame, threshold: int = 100, delay: str = "10 minutes") -> DataFrame:
    """Streak and longest run of each partition as a stream in update mode, by event time.

    ``events`` is a stream with topic, partition, offset, ``failed`` and ``timestamp``. A row comes whenever
    the watermark lets events of its partition be counted; ``tripped`` marks runs of the threshold.
    """
    kinds = ", ".join(f"{c} {events.schema[c].dataType.simpleString()}" for c in _PARTITION)
    timed = events.select(*_PARTITION, F.col("offset").cast("long"), "failed", F.col("timestamp").cast("timestamp"))
    rows = timed.mapInArrow(_carried, f"{kinds}, timestamp timestamp, packed binary").withWatermark("timestamp", delay)
    counted = rows.groupBy(*_PARTITION).transformWithStateInPandas(
        StreakStatistics(), "topic string, partition int, streak long, longest long", "update", "eventTime"
    )
    return counted.withColumn("tripped", F.col("longest") >= threshold)


def streak_state(spark: SparkSession, checkpoint: str, threshold: int = 100) -> DataFrame:
    """Streak and longest run of each partition from the state of a ``stream_streaks`` query, events on hold included."""
    state = spark.read.format("statestore").option("path", checkpoint)
    counted = state.option("stateVarName", "streak").load().select("key.*", "value.*")
    packed = state.option("stateVarName", "held").load().select("key.*", "user_map_value.packed")
    held = packed.mapInArrow(_unpacked, "topic string, partition int, offset long, failed boolean")
    return carry_streaks(counted, held).withColumn("tripped", F.col("longest") >= threshold)
