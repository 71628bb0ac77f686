from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from tracelight.operators import sampling as L
from tracelight.operators.ordering import dense_numbers, dense_offsets
from tracelight.plans.catalogue import q_sparse_keys
from tracelight.sources import messages as M


def log(spark, n, partitions=1):
    return spark.range(n * partitions).select(
        F.lit("t").alias("topic"), (F.col("id") % partitions).cast("int").alias("partition"),
        F.floor(F.col("id") / partitions).alias("offset"),
        F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, id)").alias("timestamp"),
    )


@pytest.mark.parametrize(
    "n,pct,low,high,expected,nth",
    [(17, 0.05, 10, 1000, 17, 0), (25, 0.05, 10, 100, 13, 1), (200, 0.05, 10, 1000, 10, 10),
     (200, 0.10, 10, 1000, 20, 20), (200, 1.0, 10, 100, 100, 100)],
)
def test_sampling_vectors(spark, n, pct, low, high, expected, nth):
    msgs = log(spark, n)
    assert L.sample_percentage(msgs, pct, low, high, read_cap=200).count() == expected
    assert L.sample_every_nth(msgs, pct, high, low, read_cap=200).count() == nth


def test_tail_and_count(spark):
    msgs = log(spark, 500, 2)
    tail = L.tail_per_partition(msgs, 30)
    assert tail.count() == 60 and tail.agg(F.min("offset")).first()[0] == 470
    assert sorted(r["offset"] for r in L.sample_count(msgs, 3, compat_caps=True).where("partition = 0").collect()) == [300, 301, 302]
    assert L.sample_count(msgs, 300, compat_caps=True).count() == 200
    assert L.sample_count(msgs, 300).count() == 600
    assert L.sample_all(msgs).count() == 1000 and L.sample_all(msgs, compat_caps=True).count() == 200


def test_fill_min_for_short_partitions(spark):
    assert L.sample_every_nth(log(spark, 15), 0.05, 100, 10, fill_min=True).count() == 10


def test_fraction():
    assert L.fraction(5) == 0.05 and L.fraction(1) == 1.0 and L.fraction(0.02) == 0.02
    with pytest.raises(ValueError):
        L.fraction(0)


@pytest.mark.parametrize("text,hours", [("1h", 1), ("30m", 0.5), ("2d", 48), ("3", 3), (" 2H ", 2), ("soon", 1)])
def test_time_window(text, hours):
    assert L.parse_time_window(text) == timedelta(hours=hours)


def test_time_window_sampling(spark):
    msgs = log(spark, 48).unionByName(log(spark, 1).withColumn("timestamp", F.lit(None).cast("timestamp")))
    assert L.sample_time_window(msgs, "5h", "2024-01-02 23:00:00").count() == 6


def test_bernoulli_fill(spark):
    msgs = log(spark, 400, 2)
    got = L.bernoulli_fill(msgs, 0.2, 10, 50)
    per = {r["partition"]: r for r in got.groupBy("partition").agg(F.count("*").alias("n"), F.collect_set("offset").alias("o")).collect()}
    assert set(per) == {0, 1}
    for r in per.values():
        assert 10 <= r["n"] <= 50 and set(range(10)) <= set(r["o"])
    keys = lambda df: sorted((r["partition"], r["offset"]) for r in df.collect())
    assert keys(got) == keys(L.bernoulli_fill(msgs.repartition(3), 0.2, 10, 50))


def test_sampling_keeps_a_group_limit(spark):
    plan = L.tail_per_partition(log(spark, 10), 3)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan


def test_target_counts(spark):
    profile = M.partition_profile(log(spark, 100, 3))
    target = lambda s, **k: L.target_sample_count(profile, s, **k).first()["target"]
    assert target("all") == 300 and target("count", count=7) == 21 and target("time_based") == 300
    assert target("percentage", percentage=50, min_per_partition=10, max_per_partition=40) == 120
    assert target("percentage", percentage=1.5, min_per_partition=10, max_per_partition=40) == 30


@pytest.mark.parametrize("ranges", [1, 2, 7, 256])
def test_dense_offsets(spark, ranges):
    """Dense, sparse, clustered and negative keys; a null key or group has no position."""
    keys = [*range(0, 300, 7), *(10**15 + 3 * i for i in range(300)), *(-(2**40) * i - 1 for i in range(60)), None]
    df = spark.createDataFrame([(k, None if k == 7 else (k or 0) % 2) for k in keys], "id long, g long")
    got = dense_offsets(df, F.col("g"), F.col("id"), "pos", ranges).collect()
    assert len(got) == len(keys) - 2
    for g in (0, 1):
        rows = sorted((r["id"], r["pos"]) for r in got if r["g"] == g)
        assert [p for _, p in rows] == list(range(len(rows)))
    assert dense_offsets(df.limit(0), F.col("g"), F.col("id"), "pos", ranges).count() == 0


def test_ranges_of_sparse_keys_are_even(spark):
    df = spark.range(4000).selectExpr("id * id * 1000000000 as id", "cast(id >= 0 as int) as g")
    plan = dense_offsets(df, F.col("g"), F.col("id"), "pos", 16)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in text
    cuts = df.agg(F.percentile_approx("id", [i / 16 for i in range(1, 16)], 256)).first()[0]
    sizes = [sum(low < k * k * 10**9 <= high for k in range(4000)) for low, high in zip([-1, *cuts], [*cuts, 10**18])]
    assert max(sizes) < 2 * 4000 / 16


def test_dense_numbers(spark):
    names = [f"s{i * 7919 % 500}" for i in range(500)]
    df = spark.createDataFrame([(n, 1) for n in names], "name string, x int")
    got = dense_numbers(df, ["name"], "no").collect()
    assert [r["name"] for r in sorted(got, key=lambda r: r["no"])] == sorted(names)
    assert sorted(r["no"] for r in got) == list(range(500))
    assert dense_numbers(df.limit(0), ["name"], "no").count() == 0


def test_topics(spark):
    names = ["orders", "_hidden", "__consumer_offsets", "a__transaction_state", "pay.x", "xorders"]
    msgs = spark.createDataFrame([(n, 0, 0) for n in names], "topic string, partition int, offset long")
    topics = lambda df: sorted(r["topic"] for r in df.collect())
    assert topics(M.list_topics(msgs, "ord|pay")) == ["orders", "pay.x"]
    assert topics(M.resolve_topics(msgs)) == ["orders", "pay.x", "xorders"]
    assert topics(M.resolve_topics(msgs, ["z"], ["y"])) == ["z"]
    assert topics(M.resolve_topics(msgs, None, ["y"])) == ["y"]
    assert topics(M.resolve_topics(msgs, None, ["y"], ["y("], all_topics=True)) == sorted(names)
    assert topics(M.resolve_topics(msgs, exclude_patterns=["orders", "y.x["])) == sorted(set(names) - {"orders", "xorders"})
    catalog = spark.createDataFrame([("orders",), ("nothing",)], "topic string")
    assert {r["topic"]: r["is_empty"] for r in M.empty_topics(catalog, msgs).collect()} == {"orders": False, "nothing": True}


def test_no_caps_unless_asked_for(spark):
    msgs = log(spark, 12_000)
    assert L.sample_percentage(msgs, 5).count() == 600
    assert L.sample_every_nth(msgs, 5).count() == 600
    assert L.sample_count(msgs, 500).count() == 500


def test_sampling_by_name(messages):
    rows = messages([b"{}"] * 700)
    assert L.sample(rows, "count", count=500).count() == 500
    assert L.sample(rows, "every_nth", percentage=10).count() == 70
    assert L.sample(rows, "bernoulli", percentage=100, max_per_partition=5).count() == 5
    with pytest.raises(ValueError):
        L.sample(rows, "none of these")


def test_offsets_of_keys_beyond_64_bits(spark, tmp_path):
    """Squares of order keys times a million, as ``sparse_keys`` takes them, beyond the largest long."""
    keys = [0, 7, 3_100_000, 9_000_000, 54_000_000, 54_000_001]
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got = sorted(tuple(r) for r in q_sparse_keys(spark, str(tmp_path)).collect())
    wide = sorted((k * k * 1000003 % 2, k * k * 1000003, k) for k in keys)
    place = {0: 0, 1: 0}
    expected = []
    for part, w, k in wide:
        expected.append((part, place[part], f'{{"o_orderkey":{k},"wide":{w}}}'))
        place[part] += 1
    assert got == expected
