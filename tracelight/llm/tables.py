"""Row keys, scratch tables and result columns that several operators share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelight.session import scratch_path


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows, written below the shared folder and read again: cuts the lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_keyed(docs: DataFrame, id_col: str, text_col: str, keep: list[str] | None = None) -> DataFrame:
    """``rid`` (long, unique, never null), ``owner`` (the id), ``text`` and the columns to keep."""
    return keyed_and_unique(docs, id_col, text_col, keep)[0]


def keyed_and_unique(docs: DataFrame, id_col: str, text_col: str, keep: list[str] | None = None) -> tuple[DataFrame, bool]:
    """``row_keyed``, and whether the ids are the key.

    Ids that are unique and not null are the key themselves. Otherwise the rows are numbered and
    written to the shared folder first, so that the numbers stay the same when a task is repeated.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("owner"), F.col(text_col).cast("string").alias("text"), *(keep or []))
    repeated = rows.groupBy("owner").count().filter("count > 1 or owner is null").limit(1).count()
    if repeated:
        return stored(rows.withColumn("rid", F.monotonically_increasing_id()), "rows"), False
    return rows.withColumn("rid", F.coalesce("owner", F.lit(0))), True


def slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The stretches [start, end) of ``data`` as binary values."""
    at, picked = gathered(starts, ends)
    return pa.Array.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data[picked].tobytes())]
    ).cast(pa.binary())


def gathered(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of the stretches laid end to end, and the places their members come from."""
    at = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=at[1:])
    return at, np.arange(at[-1]) + np.repeat(starts - at[:-1], np.diff(at))


def read_docs(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
