"""Stored tables as input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


# Rows that open into many field rows each, for one task.
TASK_ROWS = 5_000


def spread(df: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """Narrow rows that each open into many, dealt to tasks of about ``task_rows``: their number grows with
    the table. A scan makes few tasks of a small file, whatever is done with its rows later. The rows are counted
    now (a Parquet table by its footers)."""
    tasks = -(-df.count() // task_rows)
    return df.repartition(tasks) if tasks > 1 else df


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", partitions: int | None = None) -> DataFrame:
    """A stored table in the partitions of its scan, or dealt to ``partitions`` ones.

    ``spark.sql.files.maxPartitionBytes`` sets the size of a scan's partitions, but a row group is never
    cut: a file of one row group is read by one task. Dealing such a table out costs one shuffle of it.
    """
    df = spark.read.format(fmt).load(path)
    return df if partitions is None else df.repartition(partitions)
