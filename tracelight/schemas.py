"""Row shapes and the small fixed dimension tables of the engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Same columns as Spark's own Kafka source, so that source can be used unchanged.
MESSAGE_SCHEMA = T.StructType(
    [
        T.StructField("topic", T.StringType()),
        T.StructField("partition", T.IntegerType()),
        T.StructField("offset", T.LongType()),
        T.StructField("key", T.BinaryType()),
        T.StructField("value", T.BinaryType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField(
            "headers",
            T.ArrayType(
                T.StructType(
                    [T.StructField("key", T.StringType()), T.StructField("value", T.BinaryType())]
                )
            ),
        ),
    ]
)

FIELD_ROWS = T.StructType(
    [
        T.StructField("topic", T.StringType()),
        T.StructField("partition", T.IntegerType()),
        T.StructField("offset", T.LongType()),
        T.StructField("field_path", T.StringType()),
        T.StructField("value_type", T.StringType()),
        T.StructField("value", T.StringType()),
    ]
)

# hit_no numbers the findings of one field in one message from 1, so "messages with at least
# one finding" is a plain sum over hit_no = 1 instead of a distinct count.
DETECTION = T.StructType(
    [
        T.StructField("topic", T.StringType()),
        T.StructField("partition", T.IntegerType()),
        T.StructField("offset", T.LongType()),
        T.StructField("field_path", T.StringType()),
        T.StructField("pii_type", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("value", T.StringType()),
        T.StructField("pattern_matched", T.StringType()),
        T.StructField("provider", T.StringType()),
        T.StructField("hit_no", T.IntegerType()),
    ]
)

CLASSIFICATION = T.StructType(
    [
        T.StructField("topic", T.StringType()),
        T.StructField("field_path", T.StringType()),
        T.StructField("pii_types", T.ArrayType(T.StringType())),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("detection_count", T.LongType()),
        T.StructField("total_samples", T.LongType()),
        T.StructField("detection_rate", T.DoubleType()),
        T.StructField("sample_values", T.ArrayType(T.StringType())),
    ]
)

SCHEMA_CATALOG = T.StructType(
    [
        T.StructField("subject", T.StringType()),
        T.StructField("version", T.IntegerType()),
        T.StructField("schema_id", T.IntegerType()),
        T.StructField("schema_type", T.StringType()),
        T.StructField("schema", T.StringType()),
        T.StructField("registered_at", T.TimestampType()),
    ]
)

# The twenty types in declaration order, with label, risk level and tags.
PII_TYPES = [
    ("SSN", "Social Security Number", "high", ["PII", "PII-SSN"]),
    ("EMAIL", "Email Address", "medium", ["PII", "PII-Email"]),
    ("PHONE_NUMBER", "Phone Number", "medium", ["PII", "PII-Phone-Number"]),
    ("ADDRESS", "Physical Address", "medium", ["PII", "PII-Address"]),
    ("CREDIT_CARD", "Credit Card Number", "high", ["PII", "PII-Credit-Card"]),
    ("DATE_OF_BIRTH", "Date of Birth", "medium", ["PII", "PII-Date-Of-Birth"]),
    ("PASSPORT", "Passport Number", "high", ["PII", "PII-Passport"]),
    ("DRIVER_LICENSE", "Driver's License", "high", ["PII", "PII-Driver-License"]),
    ("IP_ADDRESS", "IP Address", "low", ["PII", "PII-IP-Address"]),
    ("NAME", "Person Name", "medium", ["PII", "PII-Name"]),
    ("BANK_ACCOUNT", "Bank Account Number", "high", ["PII", "PII-Bank-Account"]),
    ("IBAN", "International Bank Account Number", "high", ["PII", "PII-IBAN"]),
    ("SWIFT_CODE", "SWIFT/BIC Code", "medium", ["PII", "PII-SWIFT"]),
    ("AWS_ACCESS_KEY", "AWS Access Key", "high", ["PII", "PII-AWS-Access-Key", "SECRET"]),
    ("AWS_SECRET_KEY", "AWS Secret Key", "high", ["PII", "PII-AWS-Secret-Key", "SECRET"]),
    ("ITIN", "Individual Tax Identification Number", "high", ["PII", "PII-ITIN"]),
    ("NATIONAL_INSURANCE_NUMBER", "National Insurance Number", "high", ["PII", "PII-NI-Number"]),
    ("USERNAME", "Username", "low", ["PII", "PII-Username"]),
    ("PASSWORD", "Password", "high", ["PII", "PII-Password", "SECRET"]),
    ("MAC_ADDRESS", "MAC Address", "low", ["PII", "PII-MAC-Address"]),
]

TYPE_NAMES = [name for name, _, _, _ in PII_TYPES]

# The first ten types are the ones switched on by default.
CORE_TYPES = TYPE_NAMES[:10]

# Conflict priority; every type that is not listed has priority 0.
PRIORITY = {
    "CREDIT_CARD": 100,
    "SSN": 90,
    "PHONE_NUMBER": 85,
    "EMAIL": 85,
    "IP_ADDRESS": 80,
    "DRIVER_LICENSE": 75,
    "PASSPORT": 75,
    "ADDRESS": 70,
    "NAME": 65,
    "DATE_OF_BIRTH": 50,
}

# Types that make a record high risk (narrower than risk level "high").
HIGH_RISK = ["SSN", "CREDIT_CARD", "PASSPORT", "DRIVER_LICENSE"]


def pii_types(spark: SparkSession) -> DataFrame:
    """The 20-row type dimension: ordinal, type, label, risk, tags."""
    rows = [(i, n, label, risk, tags) for i, (n, label, risk, tags) in enumerate(PII_TYPES)]
    return spark.createDataFrame(
        rows, "ordinal int, pii_type string, label string, risk_level string, type_tags array<string>"
    )
