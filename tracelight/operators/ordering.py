"""Dense positions inside very large groups without sorting a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelight.operators.skew import skew_join, stored_side
from tracelight.session import scratch_path

# Offsets in one chunk of a partition, where offsets are dense.
CHUNK = 1_000_000
# Ranges of about equal row counts that a group is cut into.
RANGES = 256


def _numbered(rows: DataFrame, group: list[str], part: str, order: list[str], name: str) -> DataFrame:
    """Add ``name``: positions within ``group``, whose parts follow each other. Parts are sorted, groups are not."""
    sizes = rows.groupBy(*group, part).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group or [F.lit(0)]).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select(*group, part, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*group, part).orderBy(*order)
    ranked = rows.withColumn("_rank", F.row_number().over(inside) - 1)
    return ranked.join(base, [*group, part]).withColumn(name, (F.col("_base") + F.col("_rank")).cast("long")).drop("_rank", "_base")


def integer_key(df: DataFrame, key: Column) -> Column:
    """The key as it is if it is a decimal without fraction, which may go beyond 64 bits, else as a long."""
    kind = df.select(key).schema[0].dataType
    return key if isinstance(kind, T.DecimalType) and kind.scale == 0 else key.cast("long")


def dense_offsets(df: DataFrame, group: Column, key: Column, name: str, ranges: int = RANGES) -> DataFrame:
    """Add ``name``: 0, 1, 2 … within ``group`` in the order of the unique integer ``key``.

    Each group is cut at quantiles of its keys into ``ranges`` parts of about equal row counts, so sparse,
    dense and clustered keys cost the same. The cuts (a few hundred numbers a group) are computed now and
    stored: the part of a row follows from them and its key, hence a recomputed task gives the same positions. Only the
    row counts of the parts are summed up front to back; rows are sorted within their part. Rows with a null group
    or key are left out.
    """
    rows = df.withColumn("_group", group).withColumn("_key", integer_key(df, key))
    rows = rows.where(F.col("_group").isNotNull() & F.col("_key").isNotNull())
    shares = [i / ranges for i in range(1, ranges)] or [0.5]
    # the cuts are at most 1/16 of a part off
    found = F.percentile_approx("_key", shares, 16 * ranges)
    cuts = stored_side(rows.groupBy("_group").agg(F.array_sort(F.array_distinct(found)).alias("_cuts")), "cuts")
    parted = skew_join(rows, cuts, ["_group"]).withColumn(
        "_part", F.size(F.filter("_cuts", lambda cut: cut < F.col("_key")))
    )
    return _numbered(parted.drop("_cuts"), ["_group"], "_part", ["_key"], name).drop("_group", "_key", "_part")


def dense_numbers(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Add ``name``: 0, 1, 2 … over all rows in the order of columns of any type that together are unique.

    Rows are dealt to ranges by Spark's sampled bounds and stored with the number of their range, so the
    positions do not change when a task is repeated; then as ``dense_offsets``.
    """
    path = scratch_path(df.sparkSession, "ranges")
    df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()).write.parquet(path)
    stored = df.sparkSession.read.parquet(path)
    return _numbered(stored, [], "_part", order, name).select(*df.columns, name)
