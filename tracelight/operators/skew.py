"""Joins of a large table, whose keys may be hot, with a side that is mostly small."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelight.session import scratch_path

# What a side may hold, as text, to be broadcast, and how many copies of a larger one share the rows of a hot key.
BROADCAST_BYTES = 32 << 20
SALTS = 32

# Columns that tell the messages of one key apart.
_ROW = ("topic", "partition", "offset")


def stored_side(df: DataFrame, name: str = "side") -> DataFrame:
    """The rows of ``df`` from a table in the shared folder: computed once, however often they are read."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def measured_bytes(df: DataFrame) -> int:
    """Size of the rows of a table as JSON text."""
    return df.agg(F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0))).first()[0]


def skew_join(
    rows: DataFrame,
    side: DataFrame,
    keys: list[str],
    how: str = "inner",
    broadcast_bytes: int = BROADCAST_BYTES,
    salts: int = SALTS,
) -> DataFrame:
    """``rows.join(side, keys, how)`` where one key, or null, may hold a large share of ``rows``.

    ``how`` is inner, left, left_semi or left_anti. The side is stored and measured. Up to ``broadcast_bytes``
    it is broadcast and ``rows`` are not shuffled. Beyond that each of its rows is sent ``salts`` times, and the rows of a key are dealt
    to these copies by a hash of topic, partition and offset, so a retried task deals them alike. Rows with a null in
    the key never match; they go to all tasks alike. Rows that only differ in other columns stay together. A side that
    large is merged whatever its file size says: a small compressed file may hold more than the driver can build.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"unknown kind of join: {how}")
    kept = stored_side(side)
    if measured_bytes(kept) <= broadcast_bytes:
        return rows.join(F.broadcast(kept), keys, how)
    dealt_by = [c for c in _ROW if c in rows.columns and c not in keys]
    if not dealt_by:
        return rows.join(kept.hint("merge"), keys, how)
    coin = F.xxhash64(*dealt_by)
    no_key = F.lit(False)
    for key in keys:
        no_key = no_key | F.col(key).isNull()
    left = rows.withColumn("_salt", F.when(no_key, coin).otherwise(F.pmod(coin, F.lit(salts))))
    right = kept.withColumn("_salt", F.explode(F.expr(f"sequence(0L, {salts - 1}L)")))
    return left.join(right.hint("merge"), [*keys, "_salt"], how).drop("_salt")
