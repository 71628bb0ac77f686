import random

import pytest
from pyspark.sql import functions as F

from tracelight.operators import spans as S


def found(spark, text, types=None):
    df = spark.createDataFrame([(1, text)], "id int, text string")
    return {(r["pii_type"], r["value"]): (r["start"], r["end"]) for r in S.resolve_spans(df, "text", ["id"], types).collect()}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("pay 4111 1111 1111 1111 now", {("CREDIT_CARD", "4111 1111 1111 1111"): (4, 23)}),
        ("pay 4111111111111111 now", {("CREDIT_CARD", "4111111111111111"): (4, 20)}),
        ("é 912-34-5678", {("SSN", "912-34-5678"): (2, 13)}),
        ("id 912785678 x", {("SSN", "912785678"): (3, 12)}),
        ("mail a.b@c.org or 10.0.0.1", {("EMAIL", "a.b@c.org"): (5, 14), ("IP_ADDRESS", "10.0.0.1"): (18, 26)}),
        ("nothing here", {}),
        ("", {}),
    ],
)
def test_overlaps_are_settled(spark, text, want):
    assert found(spark, text) == want


def test_a_card_without_checksum_keeps_a_bank_account(spark):
    got = found(spark, "n 4111111111111112 n")
    assert set(got) == {("CREDIT_CARD", "4111111111111112"), ("BANK_ACCOUNT", "4111111111111112")}


def test_types_that_are_not_looked_for_beat_nothing(spark):
    assert set(found(spark, "4111111111111111", ["PHONE_NUMBER"])) == {("PHONE_NUMBER", "4111111111111")}


def test_redaction(spark):
    rows = [(1, "a 4111111111111111, b@c.de; 912-34-5678!", "k"), (2, None, "k"), (3, "plain", "k"), (4, "n 4111111111111112 n", "k")]
    df = spark.createDataFrame(rows, "id int, text string, `a.b` string")
    out = {r["id"]: r["text"] for r in S.redact_text(df, "text").collect()}
    assert S.redact_text(df, "text").columns == df.columns
    assert out == {1: "a [CREDIT_CARD], [EMAIL]; [SSN]!", 2: None, 3: "plain", 4: "n [CREDIT_CARD] n"}
    places = S.resolve_spans(df, "text", ["id", "a.b"]).where("id = 1").orderBy("start").collect()
    assert [(r["a.b"], r["pii_type"]) for r in places] == [("k", "CREDIT_CARD"), ("k", "EMAIL"), ("k", "SSN")]


def test_places_are_those_of_find_spans(spark):
    """What survives lies where the plain search finds it; rows with equal keys are texts of their own."""
    rng = random.Random(2)
    words = ["4111111111111111", "x@y.org", "10.1.2.3", "912-34-5678", "Ann Lee", "über", "555-123-4567", "12345678", "DEUTDEFF"]
    rows = [(i // 2, " ".join(rng.choices(words, k=30))) for i in range(20)]
    df = spark.createDataFrame(rows, "id int, text string")
    every = {tuple(r) for r in S.find_spans(df, "text", ["id"]).drop("span_no", "confidence").select("id", "pii_type", "start", "end", "value").collect()}
    some = [tuple(r) for r in S.resolve_spans(df, "text", ["id"]).select("id", "pii_type", "start", "end", "value").collect()]
    assert set(some) < every and len(some) > 300
    assert S.resolve_spans(df.where(F.lit(False)), "text", ["id"]).count() == 0
