import pytest
from pyspark.sql import SparkSession

from tracelight.session import prepare_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tracelight-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield prepare_session(session)
    session.stop()


@pytest.fixture(scope="session")
def field_rows(spark):
    """Build field rows from (path, value) pairs; the offset is the position in the list."""

    def build(pairs, topic="t"):
        rows = [(topic, 0, i, p, "string", v) for i, (p, v) in enumerate(pairs)]
        return spark.createDataFrame(
            rows,
            "topic string, partition int, offset long, field_path string, value_type string, value string",
        )

    return build


@pytest.fixture(scope="session")
def messages(spark):
    """Build messages from byte values."""

    def build(values, topic="t"):
        rows = [(topic, 0, i, None, v, None, None) for i, v in enumerate(values)]
        from tracelight.schemas import MESSAGE_SCHEMA

        return spark.createDataFrame(rows, MESSAGE_SCHEMA)

    return build
