import json

import pytest
from pyspark.sql import functions as F

from tracelight.functions.decoders import row_decoder
from tracelight.operators import fields as ops
from tracelight.operators.skew import skew_join


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_skew_join_is_the_plain_join(spark, how, limit):
    """One hot key, null keys, repeated rows on both sides; broadcast and salted."""
    key = F.when(F.col("id") % 3 == 0, F.lit(None)).when(F.col("id") % 3 == 1, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 7))
    rows = spark.range(3000).select(F.lit("t").alias("topic"), F.lit(0).alias("partition"), F.col("id").alias("offset"), key.alias("k"))
    side = spark.createDataFrame([("hot", 1), ("hot", 2), ("k1", 3), (None, 4), ("gone", 5)], "k string, n int")
    show = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))
    joined = skew_join(rows, side, ["k"], how, broadcast_bytes=limit, salts=4)
    assert show(joined) == show(rows.join(side, "k", how))
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert ("_salt" in plan) == (limit == 0)


def test_a_hot_key_meets_in_many_tasks(spark):
    rows = spark.range(4000).select(F.lit("t").alias("topic"), F.lit(0).alias("partition"), F.col("id").alias("offset"), F.lit("hot").alias("k"))
    side = spark.createDataFrame([("hot", 1)], "k string, n int")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = skew_join(rows, side, ["k"], broadcast_bytes=0)
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(sizes) == 4000 and len(sizes) == 4 and max(sizes) < 2400


def test_skew_join_edges(spark):
    rows = spark.createDataFrame([], "topic string, partition int, offset long, k string")
    side = spark.createDataFrame([], "k string, n int")
    assert skew_join(rows, side, ["k"], "left").count() == 0
    with pytest.raises(ValueError, match="full"):
        skew_join(rows, side, ["k"], "full")


def test_a_raising_decoder_leaves_its_row_to_the_lenient_path(spark, messages):
    def codec(payload):
        if payload.startswith(b"!"):
            raise ValueError("cut off")
        return json.dumps({"text": payload.decode()})

    frame = b"\x00\x00\x00\x00\x07"
    msgs = messages([frame + b"abc", frame + b'!{"k": 1}', frame + b"!!", b'{"plain": 2}', b"\x00\x00\x00\x00\x08" + b'{"other": 3}', None])
    catalog = spark.createDataFrame([(7, "custom"), (8, "json")], "schema_id int, schema_type string")
    rows = ops.decode_records(msgs, catalog, {"custom": row_decoder(codec)})
    got = {r["offset"]: json.loads(r["json"]) for r in rows.collect()}
    assert got == {0: {"text": "abc"}, 1: {"k": 1}, 3: {"plain": 2}, 4: {"other": 3}}


def test_a_large_side_is_never_broadcast(spark):
    rows = spark.range(50).selectExpr("'t' as topic", "0 as partition", "id as offset", "id % 5 as k")
    side = spark.range(5).selectExpr("id as k", "id as v")
    for kept in (rows, rows.select("k")):
        joined = skew_join(kept, side, ["k"], broadcast_bytes=0, salts=4)
        assert joined.count() == 50
        # the file of the side is far below the size that Spark broadcasts by itself
        assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()
