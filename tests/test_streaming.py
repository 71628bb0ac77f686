import random
from datetime import datetime, timezone

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracelight.operators import classify as C
from tracelight.operators import detect as D
from tracelight.streaming import classify as WC
from tracelight.streaming import detect as W
from tracelight.streaming import streaks as WS

DOCS = [b'{"email": "u%d@x.com", "n": %d}' % (i, i) for i in range(12)] + [b"broken", b"", b'{"full_name": "Ann Lee"}']


def store(messages, path, files=3):
    msgs = messages(DOCS).withColumn("timestamp", F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, offset)"))
    msgs.repartition(files, "offset").write.parquet(path)
    return msgs


def drain(df, out, checkpoint):
    W.write_stream(df, out, checkpoint).awaitTermination()


def test_stream_equals_batch(spark, messages, tmp_path):
    msgs = store(messages, str(tmp_path / "in"))
    stream = W.read_stream(spark, str(tmp_path / "in"), starting_position="earliest", per_trigger=1)
    drain(W.stream_detect(stream), str(tmp_path / "out"), str(tmp_path / "ck"))
    show = lambda df: sorted((r["offset"], r["pii_type"], r["value"]) for r in df.collect())
    got = spark.read.parquet(str(tmp_path / "out"))
    assert show(got) == show(D.detect_messages(msgs)) and got.count() == 13
    # A restart with the same checkpoint reads nothing twice.
    drain(W.stream_detect(stream), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 13
    types = {r["offset"]: r["pii_types"] for r in W.stream_message_types(msgs).collect()}
    assert types[0] == ["EMAIL"] and types[14] == ["NAME"] and 12 not in types
    assert [r["offset"] for r in W.dead_letters(msgs).collect()] == [12]
    stats = W.stream_stats(msgs).first()
    assert (stats["processed"], stats["errors"]) == (14, 1)


def test_offsets(spark):
    msgs = spark.createDataFrame([("a", 0, 99), ("a", 1, 5), ("b", 0, 1)], "topic string, partition int, offset long")
    nxt = W.next_offsets(msgs)
    assert {(r["topic"], r["partition"]): r["next_offset"] for r in nxt.collect()} == {("a", 0): 100, ("a", 1): 6, ("b", 0): 2}
    later = spark.createDataFrame([("a", 0, 99), ("a", 0, 100), ("c", 0, 0)], "topic string, partition int, offset long")
    assert sorted((r["topic"], r["offset"]) for r in W.resume(later, nxt).collect()) == [("a", 100), ("c", 0)]
    with pytest.raises(ValueError):
        W.read_stream(spark, "x", starting_position="middle")


def events(spark, flags, first=0):
    return spark.createDataFrame([("t", 0, first + i, bool(x)) for i, x in enumerate(flags)],
                                 "topic string, partition int, offset long, failed boolean")


def brute(flags, first=0):
    out, run = [], []
    for i, x in enumerate([*flags, 0]):
        if x:
            run.append(first + i)
        elif run:
            out.append((run[0], run[-1], len(run)))
            run = []
    return out


@pytest.mark.parametrize("chunk", [1, 3, 7, 1000])
def test_streaks_match_brute_force(spark, chunk):
    flags = random.Random(chunk).choices([0, 1], weights=[1, 3], k=120) + [1] * 25
    got = WS.failure_streaks(events(spark, flags), 4, chunk).collect()
    assert sorted((r["start_offset"], r["end_offset"], r["failures"]) for r in got) == brute(flags)
    assert all(r["tripped"] == (r["failures"] >= 4) for r in got)


def test_streak_thresholds(spark):
    assert WS.failure_streaks(events(spark, [1, 1, 1]), 3).where("tripped").count() == 1
    assert WS.failure_streaks(events(spark, [1, 1, 1, 1]), 5).where("tripped").count() == 0
    assert WS.failure_streaks(events(spark, [1, 1, 0, 1]), 3).where("tripped").count() == 0


def run(df, checkpoint, handle=lambda batch, number: batch.count()):
    query = df.writeStream.outputMode("update").foreachBatch(handle).option("checkpointLocation", checkpoint)
    query.trigger(availableNow=True).start().awaitTermination()


def test_streaks_in_state(spark, tmp_path):
    """Files in any order within the delay, a restart in the middle, events on hold at the end."""
    rng = random.Random(4)
    flags = rng.choices([0, 1], weights=[1, 3], k=240)
    stamp = F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, offset)").alias("timestamp")
    rows = events(spark, flags).select("*", stamp)
    rows = rows.unionByName(rows.withColumn("partition", F.lit(1)).withColumn("failed", ~F.col("failed")))
    path, checkpoint, seen = str(tmp_path / "in"), str(tmp_path / "ck"), []
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    for first, last in ((40, 80), (0, 40), (80, 120), (160, 200), (120, 160), (200, 240)):
        part = rows.where(f"offset >= {first} and offset < {last}").orderBy(F.rand(1)).coalesce(1)
        part.write.mode("append").parquet(path)
        run(WS.stream_streaks(stream, 5, "2 hours"), checkpoint, lambda b, _: seen.extend(b.collect()))
    want = {}
    for partition, own in ((0, flags), (1, [1 - x for x in flags])):
        runs = brute(own)
        streak = next((n for _, end, n in runs if end == 239), 0)
        longest = max(n for _, _, n in runs)
        want[partition] = (streak, longest, longest >= 5)
    got = {r["partition"]: (r["streak"], r["longest"], r["tripped"]) for r in WS.streak_state(spark, checkpoint, 5).collect()}
    assert got == want
    assert seen and any(r["tripped"] for r in seen) and all(r["longest"] <= want[r["partition"]][1] for r in seen)


def test_events_travel_to_the_state_in_few_rows(spark, tmp_path, monkeypatch):
    """Whatever the number of events, the stateful operator takes them by the thousand."""
    log = str(tmp_path / "log")

    class Counting(WS.StreakStatistics):
        def handleInputRows(self, key, rows, timerValues):
            frames = list(rows)
            with open(log, "a") as f:
                f.write(f"{sum(map(len, frames))}\n")
            yield from WS.StreakStatistics.handleInputRows(self, key, iter(frames), timerValues)

    monkeypatch.setattr(WS, "StreakStatistics", Counting)
    flags = random.Random(9).choices([0, 1], weights=[1, 3], k=30_000)
    stamp = F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, offset)").alias("timestamp")
    path, checkpoint = str(tmp_path / "in"), str(tmp_path / "ck")
    events(spark, flags).select("*", stamp).orderBy(F.rand(3)).coalesce(1).write.parquet(path)
    rows = spark.read.parquet(path)
    run(WS.stream_streaks(spark.readStream.schema(rows.schema).parquet(path), 5, "1 minute"), checkpoint)
    runs = brute(flags)
    got = WS.streak_state(spark, checkpoint, 5).first()
    assert got["longest"] == max(n for _, _, n in runs)
    assert got["streak"] == next((n for _, end, n in runs if end == len(flags) - 1), 0)
    assert sum(map(int, open(log).read().split())) < 500


def test_rows_that_carry_events():
    rng = np.random.default_rng(5)
    n = 5000
    topic = pa.array([None if x == 2 else f"t{x}" for x in rng.integers(0, 3, n)])
    partition = pa.array([None if x == 2 else int(x) for x in rng.integers(0, 3, n)], pa.int32())
    failed = pa.array([None if x == 2 else bool(x) for x in rng.integers(0, 3, n)])
    time = pa.array(rng.integers(-5_000_000, 5_000_000, n)).cast(pa.timestamp("us", "UTC"))
    names = ["topic", "partition", "offset", "failed", "timestamp"]
    batch = pa.RecordBatch.from_arrays([topic, partition, pa.array(np.arange(n)), failed, time], names=names)
    rows = next(WS._carried(iter([batch.slice(0, 0), batch]))).to_pylist()
    got = {}
    for row in rows:
        held = np.frombuffer(row["packed"], WS._EVENT)
        got |= {int(e["offset"]): (row["topic"], row["partition"], int(e["failed"]), int(e["at"])) for e in held}
        latest = time.cast(pa.int64()).to_numpy()[held["offset"]].max()
        assert row["timestamp"].timestamp() == pytest.approx(latest / 1e6, abs=1e-7)
    micros = time.cast(pa.int64()).to_pylist()
    known = {None: -1, False: 0, True: 1}
    columns = zip(topic.to_pylist(), partition.to_pylist(), failed.to_pylist(), micros, strict=True)
    assert got == {i: (t, p, known[f], at // 1000) for i, (t, p, f, at) in enumerate(columns)}
    assert sum(len(np.frombuffer(r["packed"], WS._EVENT)) for r in rows) == n and len(rows) < 9 * 50


def test_late_events_are_left_out_of_streaks(spark, tmp_path):
    """A success that comes after the watermark passed it ends no run, though it comes with events in time."""
    path, checkpoint = str(tmp_path / "in"), str(tmp_path / "ck")
    stamp = F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, at)").alias("timestamp")
    files = [[(i, i, True) for i in range(40)], [(1000, 5, False), (40, 40, True), (41, 41, True)], [(42, 80, True)]]
    for rows in files:
        df = spark.createDataFrame(rows, "offset long, at int, failed boolean")
        df.select(F.lit("t").alias("topic"), F.lit(0).alias("partition"), "offset", "failed", stamp).coalesce(1).write.mode("append").parquet(path)
        run(WS.stream_streaks(spark.readStream.schema(spark.read.parquet(path).schema).parquet(path), 5), checkpoint)
    got = WS.streak_state(spark, checkpoint, 5).first()
    assert (got["streak"], got["longest"]) == (43, 43)


def test_running_classification_survives_a_restart(spark, messages, tmp_path):
    """The second run goes on from the state of the first; nothing is counted twice."""
    path, checkpoint = str(tmp_path / "in"), str(tmp_path / "ck")
    msgs = messages(DOCS + [b'{"email": "u3@x.com", "phone": "555-123-4567"}', b'{"email": "555-123-4567"}'])
    for low, high in ((0, 6), (6, 20)):
        msgs.where(f"offset >= {low} and offset < {high}").repartition(2, "offset").write.mode("append").parquet(path)
        stream = W.read_stream(spark, path, starting_position="earliest", per_trigger=1)
        run(WC.running_statistics(stream), checkpoint)
    run(WC.running_statistics(stream), checkpoint)
    state = WC.running_state(spark, checkpoint)
    assert WC.message_totals(state).first()["total_samples"] == 17
    totals = msgs.groupBy("topic").agg(F.count("*").alias("total_samples"))
    loose = C.Thresholds(0.5, 0.0, False)
    show = lambda df: sorted(str(r.asDict()) for r in df.withColumn("confidence", F.round("confidence", 9)).collect())
    batch = show(C.classify_fields(D.detect_messages(msgs), totals, loose))
    assert len(batch) == 3 and show(WC.classify_running(state, loose)) == batch


def test_statistics_of_a_batch_hold_all_types_of_its_fields(spark, messages, tmp_path):
    path, seen = str(tmp_path / "in"), []
    for value in (b'{"contact": "a@x.com"}', b'{"contact": "555-123-4567", "other": "b@x.com"}', b"[]"):
        messages([value]).coalesce(1).write.mode("append").parquet(path)
    stream = W.read_stream(spark, path, starting_position="earliest", per_trigger=1)
    run(WC.running_statistics(stream), str(tmp_path / "ck"), lambda b, _: seen.append({(r["field_path"], r["pii_type"]): r for r in b.collect()}))
    assert {t for p, t in seen[1] if p == "contact"} == {"EMAIL", "PHONE_NUMBER"}
    assert seen[1]["contact", "EMAIL"]["sample_values"] == ["555-123-4567", "a@x.com"]
    assert list(seen[2]) == [("", "")] and seen[2]["", ""]["type_count"] == 3


def test_windows(spark, messages, tmp_path):
    msgs = store(messages, str(tmp_path / "in"), 1)
    bound = C.Thresholds(0.7, 0.3, True)
    whole = {r["window_start"].minute: r["detection_count"] for r in WC.classify_windows(msgs, "5 minutes", bound).collect()}
    assert whole == {0: 5, 5: 5, 10: 2}
    stream = W.read_stream(spark, str(tmp_path / "in"), starting_position="earliest")
    types, totals = WC.monitor_stream(stream, "5 minutes", "1 minute")
    drain(types, str(tmp_path / "a"), str(tmp_path / "ka"))
    drain(totals, str(tmp_path / "b"), str(tmp_path / "kb"))
    cls = WC.classify_closed(spark.read.parquet(str(tmp_path / "a")), spark.read.parquet(str(tmp_path / "b")), bound)
    closed = {r["window_start"].minute: r["detection_count"] for r in cls.collect()}
    assert closed == {0: 5, 5: 5}


def test_latest_leaves_out_what_lay_there_before(spark, messages, tmp_path):
    path = str(tmp_path / "in")
    messages([b'{"email": "old@x.com"}']).write.parquet(path)
    since = datetime.now(timezone.utc)
    stream = W.read_stream(spark, path, since=since, bytes_per_trigger=1)
    messages([b'{"email": "new@x.com"}', b'{"email": "newer@x.com"}']).repartition(2, "offset").write.mode("append").parquet(path)
    drain(W.stream_detect(stream), str(tmp_path / "out"), str(tmp_path / "ck"))
    # A restart that names the first start takes what came in between.
    messages([b'{"email": "last@x.com"}']).write.mode("append").parquet(path)
    again = W.read_stream(spark, path, since=since, bytes_per_trigger=1)
    drain(W.stream_detect(again), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert sorted(r["value"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["last@x.com", "new@x.com", "newer@x.com"]
    late = W.read_stream(spark, path)
    drain(W.stream_detect(late), str(tmp_path / "out2"), str(tmp_path / "ck2"))
    assert spark.read.schema(late.schema).parquet(str(tmp_path / "out2")).count() == 0
    with pytest.raises(ValueError, match="time zone"):
        W.read_stream(spark, path, since=datetime(2024, 1, 1))
