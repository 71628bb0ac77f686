import pytest
from pyspark.sql import functions as F

from tracelight.operators import classify as C
from tracelight.operators import detect as D
from tracelight.plans import catalogue
from tracelight.plans.run import RunOptions, analyze
from tracelight.schemas import CLASSIFICATION, SCHEMA_CATALOG, TYPE_NAMES


def findings(spark, rows):
    """(offset, path, type, confidence, value)"""
    return spark.createDataFrame(
        [("t", 0, i, p, t, float(c), v) for i, p, t, c, v in rows],
        "topic string, partition int, offset long, field_path string, pii_type string, confidence double, value string",
    )


def total(spark, n):
    return spark.createDataFrame([("t", n)], "topic string, total_samples long")


def email(confidences):
    return [(i, "email", "EMAIL", c, f"u{i}@x.com") for i, c in enumerate(confidences)]


def test_nothing(spark):
    assert C.classify_fields(findings(spark, []), total(spark, 10)).count() == 0


def test_low_confidence(spark):
    assert C.classify_fields(findings(spark, email([0.79] * 4)), total(spark, 10), C.Thresholds(confidence=0.8)).count() == 0


def test_mean_at_threshold_counts(spark):
    assert C.classify_fields(findings(spark, email([0.7] * 7)), total(spark, 10)).count() == 1


@pytest.mark.parametrize("hits,n", [(1, 10), (2, 20), (3, 100)])
def test_low_rate(spark, hits, n):
    assert C.classify_fields(findings(spark, email([0.95] * hits)), total(spark, n)).count() == 0


def test_valid(spark):
    row = C.classify_fields(findings(spark, email([0.95, 0.92, 0.90, 0.88])), total(spark, 10)).first()
    assert (row["detection_count"], row["detection_rate"], row["tags"]) == (4, 0.4, ["PII", "PII-Email"])
    assert row["confidence"] == pytest.approx(0.9125)
    assert row["sample_values"] == [f"u{i}@x.com" for i in range(4)]


def test_two_types(spark):
    rows = [(i, "c", "EMAIL", 0.9, f"e{i}") for i in range(2)] + [(i, "c", "NAME", c, f"n{i}") for i, c in enumerate((0.85, 0.8))]
    row = C.classify_fields(findings(spark, rows), total(spark, 5)).first()
    assert row["pii_types"] == ["EMAIL", "NAME"] and row["tags"] == ["PII", "PII-Email", "PII-Name"]
    assert row["confidence"] == pytest.approx(0.8625) and row["detection_count"] == 2


def test_single_hit(spark):
    det = findings(spark, email([0.95]))
    assert C.classify_fields(det, total(spark, 2)).count() == 0
    assert C.classify_fields(det, total(spark, 2), C.Thresholds(require_multiple=False)).count() == 1


def test_ten_samples_at_most(spark):
    det = findings(spark, email([0.9] * 15) + [(20, "email", "EMAIL", 0.9, "")])
    row = C.classify_fields(det, total(spark, 16)).first()
    assert row["sample_values"] == sorted(f"u{i}@x.com" for i in range(15))[:10]


def test_distinct_first_equals_finding_rows(field_rows, spark):
    """Counting values before the search changes nothing, whatever the thresholds."""
    pairs = [("card", "4111111111111111")] * 5 + [("card", "4532123456789010")] * 3 + [("full_name", "Ann Lee")] * 4
    pairs += [("full_name", f"Bob {c}oe") for c in "ABCDEFGHIJKLM"] + [("ip", "10.0.0.1"), ("ip", "x"), ("itin", "912701234")] * 3
    fields = field_rows(pairs)
    n = total(spark, len(pairs))
    sizes = []
    for bound in (0.0, 0.5, 0.7, 0.9):
        t = C.Thresholds(confidence=bound, min_rate=0.0)
        a = C.classify_fields(D.detect_fields(fields, TYPE_NAMES), n, t)
        b = C.classify_values(fields, n, t, TYPE_NAMES)
        show = lambda df: sorted(str(r.asDict()) for r in df.withColumn("confidence", F.round("confidence", 9)).collect())
        assert show(a) == show(b)
        sizes.append(a.select(F.sum(F.size("pii_types"))).first()[0])
    assert sizes == sorted(sizes, reverse=True)


def test_detection_stands_once_in_the_plan(field_rows, spark):
    """Statistics and sample values come from one pass over the findings."""
    fields = field_rows([("email", "a@b.com")] * 3)
    for plan in (C.classify_fields(D.detect_fields(fields), total(spark, 3)), C.classify_values(fields, total(spark, 3))):
        assert plan.count() == 1
        plan.collect()
        text = plan._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert sum("Generate posexplode" in line for line in text.splitlines()) == 1 and "Window" not in text


def test_statistics_of_a_hot_field(spark):
    """Many findings of one field become a row per type and task, with ten values at most."""
    rows = spark.range(50_000).selectExpr(
        "'t' as topic", "'f' as field_path", "if(id % 10 = 0, 'SSN', 'EMAIL') as pii_type", "lpad(id % 977, 4, '0') as value",
        "1L as n", "0.5D as confidence_sum", "1L as messages",
    ).repartition(6)
    assert C.partial_statistics(rows).count() <= 12
    found = {r["pii_type"]: r for r in C.statistics(rows).collect()}
    assert (found["SSN"]["type_count"], found["EMAIL"]["type_count"], found["SSN"]["type_confidence"]) == (5000, 45000, 0.5)
    assert found["EMAIL"]["sample_values"] == [f"{i:04d}" for i in range(10)]


def test_many_fields_are_sent_on_in_parts(spark, monkeypatch):
    monkeypatch.setattr(C, "_MOST_KEYS", 5)
    rows = spark.range(300).selectExpr(
        "'t' as topic", "concat('f', id % 30) as field_path", "'SSN' as pii_type", "cast(id as string) as value",
        "2L as n", "1.0D as confidence_sum", "if(id % 2 = 0, 1L, 0L) as messages",
    )
    found = C.statistics(rows).collect()
    assert len(found) == 30 and all((r["type_count"], r["confidence_sum"]) == (20, 10.0) for r in found)


def test_summaries(spark):
    det = findings(spark, email([0.9] * 4) + [(i, "ssn", "SSN", 0.9, "v") for i in range(4)])
    cls = C.classify_fields(det, total(spark, 5))
    topics = spark.createDataFrame([("t",), ("none",)], "topic string")
    summary = C.topic_summary(cls, total(spark, 5), topics)
    rows = {r["topic"]: r for r in summary.collect()}
    assert (rows["t"]["pii_fields_found"], rows["t"]["empty"], rows["none"]["empty"]) == (2, False, True)
    assert {r["topic"]: r["triage"] for r in C.triage_topics(summary).collect()} == {"t": "pii", "none": "empty"}
    run = C.run_summary(summary, spark.createDataFrame([("none",)], "topic string")).first()
    assert (run["topics_analyzed"], run["total_pii_fields"], run["errors"]) == (1, 2, 1)
    tags = {(r["kind"], r["label"]): r["fields"] for r in C.tags_summary(cls).collect()}
    assert tags == {("total", "fields"): 2, ("tag", "PII"): 2, ("tag", "PII-Email"): 1, ("tag", "PII-SSN"): 1,
                    ("type", "EMAIL"): 1, ("type", "SSN"): 1}
    risk = {(r["topic"], r["risk_level"]): r["fields"] for r in C.risk_rollup(cls).collect()}
    assert risk == {("t", "high"): 1, ("t", "medium"): 1, ("t", None): 2, (None, None): 2}
    records = spark.createDataFrame([("t", 0, i) for i in range(5)], "topic string, partition int, offset long")
    found = {r["offset"]: r for r in C.detection_summary(det, records).collect()}
    assert found[0]["high_risk"] and found[0]["pii_types"] == ["EMAIL", "SSN"] and found[0]["detection_count"] == 2
    assert not found[4]["pii_detected"] and found[4]["pii_types"] == [] and found[4]["max_confidence"] == 0.0


def test_analyze(messages, spark):
    docs = [b'{"email": "a%d@b.com", "user": {"full_name": "Ann Lee"}}' % i for i in range(5)] + [b"broken"]
    result = analyze(messages(docs), options=RunOptions())
    rows = {r["field_path"]: r for r in result.classifications.collect()}
    assert set(rows) == {"email", "user.full_name"}
    assert rows["email"]["total_samples"] == 6 and rows["email"]["detection_count"] == 5
    assert result.summary.first()["samples"] == 6


def test_analyze_with_schema_provider(messages, spark):
    from tracelight.operators import providers as V

    class Model:
        def is_available(self):
            return True

        def detect_in_schema(self, prompts):
            assert set(prompts.columns) == {"topic", "field_count", "fields_text"}
            return spark.createDataFrame(
                [("t", "code", "PASSPORT", 0.9, "v", "m"), ("t", "email", "NAME", 0.9, "v", "m")],
                "topic string, field_path string, pii_type string, confidence double, value string, pattern_matched string",
            )

    V.register_provider("test-model", Model)
    docs = [b'{"email": "a%d@b.com", "code": "k"}' % i for i in range(4)]
    rows = {r["field_path"]: r["pii_types"] for r in
            analyze(messages(docs), options=RunOptions(providers=["test-model"])).classifications.collect()}
    assert rows == {"email": ["EMAIL"], "code": ["PASSPORT"]}


def test_array_items_count_as_one_field(messages):
    from tracelight.plans.run import RunOptions, analyze

    values = [b'{"c": [{"e": "a@b.com"}, {"e": "a@b.com"}, {"e": "d@e.org"}]}', b'{"c": [{"e": "x@y.net"}]}', b'{"c": []}', b"{}"]
    plain = analyze(messages(values)).classifications.collect()
    assert {(r["field_path"], r["detection_count"]) for r in plain} == {("c[0].e", 2)}
    merged = analyze(messages(values), options=RunOptions(normalize_paths=True))
    row = merged.classifications.collect()
    assert [(r["field_path"], r["detection_count"], r["detection_rate"]) for r in row] == [("c.e", 2, 0.5)]
    assert row[0]["sample_values"] == ["a@b.com", "d@e.org", "x@y.net"] and merged.errors.count() == 0


def test_words_are_searched_once_for_two_providers(spark, tmp_path):
    rows = [(0, "ann@x.com now"), (1, "call 555-123-4567"), (2, "nothing here")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = catalogue.q_dedupe_findings(spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1
    got = sorted((r["offset"] >> 31, r["pii_type"], r["confidence"], r["provider"]) for r in found.collect())
    assert got == [(0, "EMAIL", 0.99, "second"), (1, "PHONE_NUMBER", 0.7, "pattern")]


@pytest.mark.parametrize("name", ["topic_reports", "write_report", "tag_catalog", "backup_schemas"])
def test_classifications_are_computed_once(spark, monkeypatch, name):
    """Several jobs or branches read them: a row is made once."""
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    row = ("orders", "mail", ["EMAIL"], ["PII"], 0.9, 3, 4, 0.75, ["a@x.com"])
    cls = spark.createDataFrame([row], CLASSIFICATION).mapInArrow(count, CLASSIFICATION)
    schema = '{"type":"record","name":"r","fields":[{"name":"mail","type":"string"}]}'
    catalog = spark.createDataFrame([("orders-value", 1, 1, "AVRO", schema, None)], SCHEMA_CATALOG)
    monkeypatch.setattr(catalogue, "_classified", lambda *_: cls)
    monkeypatch.setattr(catalogue, "_avro_catalog", lambda *_: catalog)
    monkeypatch.setattr(catalogue, "all_totals", lambda *_: spark.createDataFrame([("orders", 4)], "topic string, total_samples long"))
    rows = catalogue.QUERIES[name](spark, "").collect()
    assert len(rows) == 1 and "orders" in str(rows[0]) and made.value == 1
