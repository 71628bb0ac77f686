"""The schema catalog: an append-only table of subjects and versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelight.operators.ordering import dense_numbers
from tracelight.schemas import SCHEMA_CATALOG


def schema_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Read a stored catalog; a missing type means AVRO."""
    rows = spark.read.schema(SCHEMA_CATALOG).parquet(path)
    return rows.withColumn("schema_type", F.coalesce("schema_type", F.lit("AVRO")))


def latest_schema(catalog: DataFrame, subjects: list[str] | None = None) -> DataFrame:
    """The highest version of each subject. One partial aggregate, no sort."""
    rows = catalog.where(F.col("subject").isin(*subjects)) if subjects else catalog
    row = F.struct(*[F.col(c) for c in catalog.columns if c != "subject"])
    best = rows.groupBy("subject").agg(F.max_by(row, F.col("version")).alias("row"))
    return best.select("subject", "row.*").select(*catalog.columns)


def schema_as_of(catalog: DataFrame, subject: str, version: int) -> DataFrame:
    """One given version of a subject."""
    return catalog.where((F.col("subject") == subject) & (F.col("version") == version))


def schema_by_id(catalog: DataFrame, schema_id: int) -> DataFrame:
    """The schema with a given id."""
    return catalog.where(F.col("schema_id") == schema_id)


def schema_exists(names: DataFrame, catalog: DataFrame) -> DataFrame:
    """Each subject name with ``exists``."""
    known = catalog.select("subject").distinct().withColumn("known", F.lit(True))
    return names.select("subject").join(known, "subject", "left").select(
        "subject", F.col("known").isNotNull().alias("exists")
    )


def list_subjects(catalog: DataFrame) -> DataFrame:
    """All subjects."""
    return catalog.select("subject").distinct()


def new_versions(catalog: DataFrame, new: DataFrame) -> DataFrame:
    """Rows to append for ``new`` (subject, schema, schema_type): next version, new ids.

    Ids go on after the highest one of the catalog, in subject order. Subjects are numbered by ranges, none of
    which is all of them.
    """
    top = catalog.groupBy("subject").agg(F.max("version").alias("top"))
    top_id = catalog.agg(F.coalesce(F.max("schema_id"), F.lit(0))).scalar()
    return (
        dense_numbers(new.join(top, "subject", "left"), ["subject"], "number")
        .select(
            "subject",
            (F.coalesce("top", F.lit(0)) + 1).cast("int").alias("version"),
            (top_id + F.col("number") + 1).cast("int").alias("schema_id"),
            F.coalesce("schema_type", F.lit("AVRO")).alias("schema_type"),
            "schema",
            F.current_timestamp().alias("registered_at"),
        )
    )


def register_schema(catalog: DataFrame, path: str, subject: str, schema: str, schema_type: str = "AVRO") -> int:
    """Append a new version to the stored catalog and return its id."""
    spark = catalog.sparkSession
    new = spark.createDataFrame([(subject, schema, schema_type)], "subject string, schema string, schema_type string")
    row = new_versions(catalog, new).first()
    spark.createDataFrame([row], SCHEMA_CATALOG).write.mode("append").parquet(path)
    return row["schema_id"]
