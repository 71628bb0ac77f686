"""Rendezvous hashing of records over weighted shards, with gapless places inside each shard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SHARDS = 24
#: Rows that get their places in one task.
ROWS_PER_BUCKET = 100_000


def rendezvous(key: Column, weights: list[float]) -> Column:
    """The shard of least -ln(u) / weight, u being a hash of key and shard number in (0, 1).

    A new shard at the end of ``weights`` only takes rows into itself. A null key is one key.
    """
    shards = F.array([F.struct(F.lit(i).alias("shard"), F.lit(float(w)).alias("weight")) for i, w in enumerate(weights)])

    def score(s: Column) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(key, s["shard"]), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
        return F.struct((-F.log(u) / s["weight"]).alias("score"), s["shard"].alias("shard"))

    return F.array_min(F.transform(shards, score))["shard"]


def place_in_shard(rows: DataFrame, shard: str, key: list[str], slot: str = "slot") -> DataFrame:
    """Adds ``slot``: 0, 1, 2, ... within each shard, in the order of hash buckets, then of ``key``.

    Rows are numbered in buckets of about ``ROWS_PER_BUCKET``; only bucket counts meet per shard.
    """
    buckets = max(1, rows.count() // ROWS_PER_BUCKET)
    dealt = rows.withColumn("_bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)))
    before = Window.partitionBy(shard).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        dealt.groupBy(shard, "_bucket")
        .count()
        .select(shard, "_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    )
    within = Window.partitionBy(shard, "_bucket").orderBy(*key)
    return (
        dealt.withColumn("_place", F.row_number().over(within))
        .join(starts, [shard, "_bucket"])
        .withColumn(slot, (F.col("_start") + F.col("_place") - 1).cast("long"))
        .drop("_bucket", "_place", "_start")
    )


def assign_shards(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    weights: list[float] | None = None,
    new_weight: float = 1.0,
    keep: list[str] | None = None,
) -> DataFrame:
    """Every row with size, text CRC-32, shard and slot, and the shard it had with one more shard.

    The id and the weights alone decide the shard. Null text counts as empty, a null id as one key.
    Repeated rows share a shard and get slots of their own. ``keep`` names columns to carry along;
    other extra columns are not looked at. An empty table gives an empty result.
    """
    weights = weights or [1.0] * SHARDS
    data = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    rows = docs.select(
        F.col(id_col),
        (F.octet_length(data) + 8).cast("long").alias("size"),
        F.crc32(data).alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous(F.col(id_col), weights).alias("shard"),
        rendezvous(F.col(id_col), [*weights, new_weight]).alias("grown_shard"),
        *[c for c in keep or [] if c != id_col],
    )
    placed = place_in_shard(rows, "shard", [id_col, "size", "text_crc32"])
    return placed.select(id_col, "size", "text_crc32", "law", "shard", "slot", "grown_shard", *[c for c in keep or [] if c != id_col])
