import pandas as pd
import pytest
from pyspark.sql import functions as F

from tracelight.operators import detect as D
from tracelight.operators import providers as V
from tracelight.plans.run import RunOptions, analyze
from tracelight.schemas import TYPE_NAMES


def test_entity_maps():
    assert {p: len(m) for p, m in V.PROVIDER_ENTITIES.items()} == {"presidio": 14, "aws": 20, "gcp": 20, "azure": 18, "model": 31}
    assert {t for m in V.PROVIDER_ENTITIES.values() for t in m.values()} <= set(TYPE_NAMES)


def test_normalize_and_likelihood(spark):
    df = spark.createDataFrame([("aws", "PERSON", "LIKELY"), ("aws", "WHAT", "X"), ("gcp", "PASSPORT", "X")], "provider string, entity string, l string")
    rows = V.normalize_findings(df).withColumn("c", V.likelihood_to_confidence(F.col("l"))).collect()
    assert sorted((r["pii_type"], r["c"]) for r in rows) == [("NAME", 0.7), ("PASSPORT", 0.5)]


def test_spans(spark):
    df = spark.createDataFrame([("hello world", 6, 11), ("hello", None, None)], "text string, begin int, end int")
    assert [r["value"] for r in V.slice_spans(df).collect()] == ["world", "hello"]
    spans = spark.createDataFrame([("phone", "123", 0, 10), ("phone", "123", 7, 10), ("phone", "123", 0, 5)],
                                  "field_path string, field_value string, begin int, end int")
    assert [(r["value"], r["pattern_matched"]) for r in V.keep_whole_value_spans(spans).collect()] == [("123", "123")] * 2


def test_schema_response(spark):
    known = spark.createDataFrame([("t", "email"), ("t", "ssn")], "topic string, field_path string")
    answers = [
        'x ```json\n[{"field":"email","pii_type":"EMAIL","confidence":0.95,"reasoning":"r"},{"field":"ghost","pii_type":"SSN"}]\n``` y',
        '[{"field":"ssn","pii_type":"social security","confidence":"7"},{"field":"email","pii_type":"weird"}]',
        "no json", '[]', '[{"field":"email","pii_type":"phone"}]',
    ]
    df = spark.createDataFrame([("t", a) for a in answers], "topic string, response string")
    got = sorted((r["field_path"], r["pii_type"], r["confidence"], r["needs_value_check"]) for r in V.parse_schema_response(df, known).collect())
    assert got == [("email", "EMAIL", 0.95, False), ("email", "PHONE_NUMBER", 0.8, True), ("ssn", "SSN", 1.0, False)]


def test_field_response(spark):
    answers = ['{"pii": true, "type": "credit card", "confidence": 0.9}', '{"pii": false}', "```json\n{\"pii\": true, \"type\": \"EMAIL\"}\n```",
               '{"pii": true, "type": "other"}', "nothing"]
    df = spark.createDataFrame([("t", 0, i, "f", "v", a) for i, a in enumerate(answers)],
                               "topic string, partition int, offset long, field_path string, value string, response string")
    got = {r["offset"]: (r["pii_type"], r["confidence"]) for r in V.parse_field_response(df).collect()}
    assert got == {0: ("CREDIT_CARD", 0.9), 2: ("EMAIL", 0.8)}


def test_verification_gate(spark):
    analyses = spark.createDataFrame(
        [("t", "a", "SSN", 0.9, False), ("t", "b", "SSN", 0.7, True), ("t", "c", "SSN", 0.7, True), ("t", "d", None, 0.99, False), ("t", "e", "SSN", 0.86, True)],
        "topic string, field_path string, pii_type string, confidence double, needs_value_check boolean")
    verdicts = spark.createDataFrame([("t", "b", True, 0.8), ("t", "c", True, 0.6)], "topic string, field_path string, confirmed boolean, confidence double")
    got = {r["field_path"]: r["confidence"] for r in V.verification_gate(analyses, verdicts).collect()}
    assert got == {"a": 0.9, "b": 0.8, "e": 0.86}
    none = spark.createDataFrame([], "topic string, field_path string")
    assert {r["field_path"] for r in V.verification_gate(analyses, verdicts, none).collect()} == {"a", "e"}


def test_prompts(field_rows, spark):
    fields = field_rows([("a", "1"), ("b", "x" * 250), ("a", "2"), ("a", "3"), ("a", "4"), ("c", None)])
    uncovered = fields.select("topic", "field_path").distinct()
    assert V.build_schema_prompts(fields, uncovered).first()["fields_text"] == "- a: [1, 2, 3]\n- b\n- c"
    values = field_rows([("a", "xx"), ("a", "xxx"), ("a", "x" * 1001)])
    assert V.eligible_values(values).count() == 2 and V.eligible_values(values, most=1000).count() == 1


def test_registry():
    V.register_provider("Mine", V.PatternProvider, aliases=["other"])
    assert isinstance(V.create_provider("MINE"), V.PatternProvider) and "other" in V.available_providers()
    V.register_provider("aws", V.PatternProvider)
    assert isinstance(V.create_provider("comprehend"), V.PatternProvider)
    with pytest.raises(ValueError):
        V.create_provider("unknown")
    with pytest.raises(ValueError):
        V.register_provider("bad", dict)
    with pytest.raises(ValueError):
        V.active_providers(["unknown"], use_pattern=False)
    assert len(V.create_provider("pattern").supported_types()) == 15


def test_detect_with(field_rows):
    def shout(path, value):
        return [("PASSWORD", 0.8, value)] if value.isupper() else []

    V.register_provider("shout", lambda: V.RowProvider("shout", shout, ["PASSWORD"]))
    fields = field_rows([("email", "a@b.com"), ("k", "SECRET"), ("x", "4111111111111111")])
    got = {(r["offset"], r["pii_type"], r["provider"], r["hit_no"]) for r in V.detect_with(fields, ["shout"], TYPE_NAMES).collect()}
    assert got == {(0, "EMAIL", "pattern", 1), (1, "PASSWORD", "shout", 1), (2, "CREDIT_CARD", "pattern", 1)}
    with pytest.raises(ValueError, match="gone"):
        V.detect_with(fields, ["shout", "gone"], TYPE_NAMES)


def test_spread(field_rows, spark):
    fields = field_rows([("a", "1"), ("a", "2"), ("b", "3")])
    findings = spark.createDataFrame([("t", "a", "SSN", 0.9, "v", "m"), ("t", "a", "NAME", 0.9, "v", "m"), ("t", "b", "IBAN", 0.9, "v", "m")],
                                     "topic string, field_path string, pii_type string, confidence double, value string, pattern_matched string")
    got = V.spread_schema_findings(findings, fields)
    assert sorted((r["offset"], r["pii_type"], r["hit_no"]) for r in got.collect()) == [(0, "NAME", 1), (0, "SSN", 2), (1, "NAME", 1), (1, "SSN", 2)]
    assert V.uncovered_fields(fields, got).first()["field_path"] == "b"
    assert D.filter_enabled(got, []).count() == 0


def test_failing_detector_gives_error_rows(field_rows):
    def picky(path, value):
        if value == "boom":
            raise KeyError("no")
        return [("PASSWORD", 0.9, value)] if value == "secret" else []

    V.register_provider("picky", lambda: V.RowProvider("picky", picky, ["PASSWORD"]))
    fields = field_rows([("a", "secret"), ("b", "boom"), ("c", "a@b.com"), ("d", "boom")])
    got = {(r["offset"], r["pii_type"]) for r in V.detect_with(fields, ["picky"], TYPE_NAMES).collect()}
    assert got == {(0, "PASSWORD"), (2, "EMAIL")}
    found, errors = V.run_providers(fields, ["picky"], TYPE_NAMES)
    assert {(r["offset"], r["pii_type"]) for r in found.collect()} == got
    assert [tuple(r) for r in errors.collect()] == [("t", "picky", "KeyError: 'no'", 2)]
    assert V.run_providers(fields)[1].count() == 0


def test_each_value_reaches_a_column_provider_once(field_rows, spark):
    seen = spark.sparkContext.accumulator(0)

    def upper(paths, values):
        if (values == "boom").any() and len(values) > 1:
            raise ValueError("a batch with a bad value")
        if (values == "boom").any():
            raise ValueError("bad")
        seen.add(len(values))
        hit = values[values.str.isupper()]
        return pd.DataFrame({"row": [values.index.get_loc(i) for i in hit.index], "pii_type": "PASSWORD", "confidence": 0.8, "pattern_matched": hit.to_list()})

    V.register_provider("upper", lambda: V.ColumnProvider("upper", upper, ["PASSWORD"]))
    values = [("a", "X"), ("a", "y"), ("a", "X"), ("b", "X"), ("c", "Z"), ("c", None)]
    found, errors = V.run_providers(field_rows(values).coalesce(1), ["upper"], TYPE_NAMES)
    assert sorted(r["offset"] for r in found.collect()) == [0, 2, 3, 4] and errors.count() == 0
    assert seen.value == 4  # distinct pairs, in one run for both results
    bad = field_rows([*values, ("d", "boom"), ("e", "boom"), ("f", "Q")]).coalesce(1)
    found, errors = V.run_providers(bad, ["upper"], TYPE_NAMES)
    assert sorted(r["offset"] for r in found.collect()) == [0, 2, 3, 4, 8]
    assert [tuple(r) for r in errors.collect()] == [("t", "upper", "ValueError: bad", 2)]


def test_providers_that_fail_as_a_whole(field_rows, messages):
    class Broken:
        def is_available(self):
            return True

        def detect(self, fields):
            raise RuntimeError("no connection")

    class BrokenSchema:
        def is_available(self):
            return True

        def detect_in_schema(self, prompts):
            raise RuntimeError("no model")

    V.register_provider("broken", Broken)
    V.register_provider("broken_schema", BrokenSchema)
    msgs = messages([b'{"a": "u@x.com", "b": 1}'])
    with pytest.warns(UserWarning, match="left out"):
        result = analyze(msgs, options=RunOptions(providers=["broken", "broken_schema"]))
    got = sorted(tuple(r) for r in result.errors.select("provider", "error", "failures").collect())
    assert got == [("broken", "RuntimeError: no connection", 1), ("broken_schema", "RuntimeError: no model", 1)]
    assert [r["pii_type"] for r in result.detections.collect()] == ["EMAIL"]
