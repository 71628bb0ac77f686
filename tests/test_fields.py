import json

from tracelight.functions.text import mask, normalize_path, sanitize_field_name
from tracelight.operators import fields as ops
from tracelight.operators.detect import detect_fields
from pyspark.sql import functions as F

from tracelight.schemas import TYPE_NAMES


def leaves(df):
    return {r["field_path"]: r["value"] for r in df.collect()}


def as_messages(messages, *docs):
    return ops.parse_json_lenient(messages([d if isinstance(d, bytes) else json.dumps(d).encode() for d in docs]))


def test_flatten(messages):
    doc = {"a": {"b": {"c": 1}}, "l": [1, 2], "o": [{"b": 1}], "ll": [[1, [2]], 3], "e": {}, "z": [], "n": None}
    got = leaves(ops.flatten(as_messages(messages, doc)))
    assert got == {"a.b.c": "1", "l[0]": "1", "l[1]": "2", "o[0].b": "1", "ll[0]": "[1,[2]]", "ll[1]": "3", "n": None}


def test_flatten_empty_and_top_level_array(messages):
    assert ops.flatten(as_messages(messages, {})).count() == 0
    assert ops.flatten(as_messages(messages, [{"x": 1}])).count() == 0


def test_extract_fields(messages):
    doc = [{"x": 1, "ll": [[1, [2, {"k": "v"}]], 3]}, 7]
    got = leaves(ops.extract_fields(as_messages(messages, doc)))
    assert got == {"[0].x": "1", "[0].ll[0][0]": "1", "[0].ll[0][1][0]": "2", "[0].ll[0][1][1].k": "v", "[0].ll[1]": "3", "[1]": "7"}


def test_extract_fields_depth_and_arrays(messages):
    doc = {"s": 0, "d": {"s": 1, "d": {"s": 2, "l": [3, {"q": 4}]}}}
    at = lambda d, **k: leaves(ops.extract_fields(as_messages(messages, doc), max_depth=d, **k))
    assert at(0) == {"s": "0"}
    assert at(1) == {"s": "0", "d.s": "1"}
    assert at(2) == {"s": "0", "d.s": "1", "d.d.s": "2", "d.d.l[0]": "3"}
    assert at(3)["d.d.l[1].q"] == "4"
    assert at(10, include_arrays=False) == {"s": "0", "d.s": "1", "d.d.s": "2"}


def test_very_deep_record_is_complete(messages):
    doc = "leaf"
    for _ in range(40):
        doc = {"k": doc}
    assert leaves(ops.flatten(as_messages(messages, doc))) == {".".join(["k"] * 40): "leaf"}


def test_value_types(messages):
    doc = {"b": True, "i": 1, "f": 1.5, "s": "x", "n": None, "big": 12345678901234567890123, "l": [[1]]}
    rows = {r["field_path"]: r["value_type"] for r in ops.flatten(as_messages(messages, doc)).collect()}
    assert rows == {"b": "boolean", "i": "integer", "f": "number", "s": "string", "n": None, "big": "integer", "l[0]": "array"}


def test_lenient_json(messages):
    values = [
        b'\x00\x00\x00\x00\x01{"key": "value"}', b"not json", b'{"a":1} x', b'{"a":1} {"b":2}', b'{"a":1,"a":2}',
        b"\xff\xfe[1]", b'  {"a": "br{ce \\" ]"} ', b"", None, b'"text"', "{\"é\":\"ü\"}".encode(),
    ]
    rows = ops.parse_json_lenient(messages(values)).orderBy("offset").collect()
    got = [r["json"] for r in rows]
    assert got == ['{"key": "value"}', None, None, None, '{"a":1,"a":2}', "[1]", '{"a": "br{ce \\" ]"}', None, None, None, '{"é":"ü"}']


def test_duplicate_key_last_wins(messages):
    assert leaves(ops.flatten(as_messages(messages, b'{"a":1,"a":2}'))) == {"a": "2"}


def test_wire_format(messages, spark):
    msgs = messages([b'\x00\x00\x00\x01\x02{"a":1}', b'{"a":1}', b"\x00\x00"])
    rows = ops.split_wire_format(msgs).orderBy("offset").collect()
    assert [(r["framed"], r["schema_id"], bytes(r["payload"])) for r in rows] == [
        (True, 258, b'{"a":1}'), (False, None, b'{"a":1}'), (False, None, b"\x00\x00")]


def test_decode_records(messages, spark):
    msgs = messages([b'\x00\x00\x00\x00\x01{"a":1}', b'\x00\x00\x00\x00\x0242', b"{}", b"[]", b'{"b":2}', b"junk"])
    catalog = spark.createDataFrame([(1, "PROTOBUF"), (2, "custom")], "schema_id int, schema_type string")
    decoders = {"CUSTOM": lambda payload: payload.cast("string")}
    rows = ops.decode_records(msgs, catalog, decoders).orderBy("offset").collect()
    assert [(r["offset"], r["json"]) for r in rows] == [(0, '{"a":1}'), (1, '{"value":42}'), (4, '{"b":2}')]


def test_infer_schema(messages):
    docs = [{"k": i, "m": 1 if i % 2 else "x", "u": None} for i in range(7)] + [{"k": None, "o": 1.5}, {"o": 2}]
    rows = {r["field_path"]: r for r in ops.infer_schema(ops.extract_fields(as_messages(messages, *docs))).collect()}
    k = rows["k"]
    assert (k["type"], k["nullable"], k["sample_count"], k["total_count"]) == ("integer", True, 7, 8)
    assert k["sample_values"] == ["0", "1", "2", "3", "4"]
    assert rows["m"]["type"] == "string" and not rows["m"]["nullable"]
    assert (rows["u"]["type"], rows["u"]["nullable"], rows["u"]["sample_values"]) == ("unknown", True, [])
    assert rows["o"]["type"] == "integer" and rows["o"]["few_samples"]


def test_table_fields(spark):
    df = spark.createDataFrame([(7, " x ", True, [1])], "id long, s string, b boolean, l array<int>")
    rows = {r["field_path"]: r for r in ops.table_fields(df, "tab", "id").collect()}
    assert {p: r["value"] for p, r in rows.items()} == {"id": "7", "s": "x", "b": "true", "l": "[1]"}
    assert (rows["s"]["partition"], rows["s"]["offset"]) == (1, 7)


def test_text_helpers(spark):
    df = spark.createDataFrame([("123-45-6789",), ("",), ("ab",), (None,)], "v string")
    rows = df.select(mask(F.col("v")).alias("m0"), mask(F.col("v"), 4).alias("m4")).collect()
    assert [(r["m0"], r["m4"]) for r in rows] == [("*" * 11, "*******6789"), ("", ""), ("**", "**"), ("", "")]
    one = spark.createDataFrame([("_user@email#field_", "a[0].b[12][3]")], "n string, p string")
    row = one.select(sanitize_field_name(F.col("n")).alias("n"), normalize_path(F.col("p")).alias("p")).first()
    assert (row["n"], row["p"]) == ("user_email_field", "a.b")


def test_deep_records_are_found_by_a_run(spark, messages):
    """A value at level 13 is found with and without a schema."""
    from tracelight.plans.run import RunOptions, analyze

    value = b'{"a":' * 12 + b'{"email": "someone@example.com"}' + b"}" * 12
    found = analyze(messages([value] * 3), options=RunOptions(strategy="all"))
    assert [r["field_path"] for r in found.classifications.collect()] == ["a." * 12 + "email"]


def _parses(df):
    """How often the executed plan parses JSON, adaptive plans counted once."""
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return sum(line.count("parseJson") for line in text.splitlines())


def test_a_message_is_parsed_once(messages, spark):
    from tracelight.operators.detect import detect_messages, message_types
    from tracelight.plans.run import field_rows

    msgs = messages([b'{"email": "a@b.com", "l": [[1]]}', b"junk", b"{}", b'\x01{"a":{"b":2}}'])
    parsed = ops.parse_json_lenient(msgs)
    catalog = spark.createDataFrame([(1, "JSON", "t-value")], "schema_id int, schema_type string, subject string")
    plans = {
        "flatten": ops.flatten(parsed),
        "extract": ops.extract_fields(parsed),
        "filtered": ops.flatten(parsed.where("json is not null")),
        "infer": ops.infer_schema(ops.extract_fields(parsed)),
        "detect": detect_messages(msgs),
        "types": message_types(msgs),
        "decode": ops.decode_records(msgs),
        "decode with codecs": ops.flatten(ops.decode_records(msgs, catalog, {"JSON": lambda p: p.cast("string")})),
        "by mode": field_rows(msgs, catalog),
    }
    assert {name: _parses(df) for name, df in plans.items()} == dict.fromkeys(plans, 1)


def test_mode_of_each_topic(messages, spark):
    """Topics with a schema keep lists in lists as values, others open them; both in one pass."""
    from tracelight.plans.run import field_rows

    msgs = messages([b'{"l": [[1]]}'], "known").unionByName(messages([b'{"l": [[1]]}', b'[{"x": 2}]'], "other"))
    catalog = spark.createDataFrame([(1, "JSON", "known-value")], "schema_id int, schema_type string, subject string")
    rows = [(r["topic"], r["field_path"], r["value"]) for r in field_rows(msgs, catalog).collect()]
    assert sorted(rows) == [("known", "l[0]", "[1]"), ("other", "[0].x", "2"), ("other", "l[0][0]", "1")]


def test_candidates_of_records(messages):
    """Which part of a value is the record is decided by its brackets."""
    values = [
        b'[{"a":1}}', b'[bad {"a":1}]', b'[bad {"a":1}', b'x["y"', b'{"a":[1,{"b":2}]}', b'{"a":1}]', b'\xfe{"a":1}\n', b'["{", "]"]',
    ]
    rows = ops.parse_json_lenient(messages(values)).orderBy("offset").collect()
    assert [(r["json"], r["levels"]) for r in rows] == [
        (None, None), (None, None), ('{"a":1}', 1), (None, None), ('{"a":[1,{"b":2}]}', 3), (None, None), ('{"a":1}', 1), ('["{", "]"]', 1),
    ]


def test_records_of_text_alone(spark):
    """Messages that only carry the text of their record are parsed on the way."""
    df = spark.createDataFrame([("t", 0, 1, '{"a":[1]}')], "topic string, partition int, offset long, json string")
    assert leaves(ops.flatten(df)) == {"a[0]": "1"}


def test_profiles_of_hot_and_many_fields(spark, monkeypatch):
    """Five values come from the earliest messages, whatever the partitions; equal ones stay."""
    monkeypatch.setattr(ops, "_MOST_KEYS", 3)
    rows = spark.range(30_000).selectExpr(
        "if(id = 29999, null, 't') as topic", "cast(id % 3 as int) as partition", "id as offset",
        "if(id % 5 = 0, 'hot', concat('f', id % 17)) as field_path",
        "case when id % 7 = 0 then null when id % 2 = 0 then 'integer' else 'number' end as value_type",
        "if(id % 7 = 0, null, cast(id % 10 as string)) as value",
    ).repartition(5).cache()
    got = {(r["topic"], r["field_path"]): r for r in ops.infer_schema(rows).collect()}
    want = {}
    for r in sorted(rows.collect(), key=lambda r: (r["partition"], r["offset"])):
        want.setdefault((r["topic"], r["field_path"]), []).append(r)
    assert set(got) == set(want)
    for key, own in want.items():
        typed = [r for r in own if r["value_type"]]
        row = got[key]
        assert (row["sample_count"], row["total_count"]) == (len(typed), len(own))
        assert row["sample_values"] == [r["value"] for r in typed[:5]]
        kinds = {r["value_type"] for r in typed}
        assert row["type"] == (min(kinds) if kinds else "unknown")
    assert ops.infer_schema(rows.where("false")).count() == 0


def test_text_fields(spark):
    """Lines and sentences are values; empty ones keep their number, null and empty texts have none."""
    from tracelight.operators.detect import detect_pattern

    text = "\n Ada Lovelace.  Card 4111 1111 1111 1111 was used!\n\n\t \nCall (555) 123-4567? v1.2 stays.\r\n"
    df = spark.createDataFrame([(7, text, "x"), (8, None, "x"), (9, "", "x"), (None, "One.", None)], "id long, text string, `a.b` string")
    rows = ops.text_fields(df, F.col("`a.b`"), "id", "text").collect()
    assert [(r["topic"], r["partition"], r["offset"], r["field_path"], r["value"]) for r in rows] == [
        # the empty first line is number 0; a mark and the empty lines after it are one end
        ("x", 1, 7, "text[1]", "Ada Lovelace"),
        ("x", 1, 7, "text[2]", "Card 4111 1111 1111 1111 was used"),
        ("x", 1, 7, "text[3]", "Call (555) 123-4567"),
        ("x", 1, 7, "text[4]", "v1.2 stays"),
        (None, None, None, "text[0]", "One."),
    ]
    fields = ops.text_fields(df.where("id = 7"), "t", "id", "text")
    types = {(r["field_path"], r["pii_type"]) for r in detect_pattern(fields).collect()}
    assert {("text[1]", "NAME"), ("text[2]", "CREDIT_CARD"), ("text[3]", "PHONE_NUMBER")} <= types
    assert ops.text_fields(df.where("false"), "t", "id", "text").count() == 0


def test_text_fields_cut_where_asked(spark):
    df = spark.createDataFrame([(1, "a; b ;c")], "id long, body string")
    assert leaves(ops.text_fields(df, "t", "id", "body", boundary=";")) == {"body[0]": "a", "body[1]": "b", "body[2]": "c"}


def test_searched_cells_lose_no_finding(spark):
    """Values on both sides of what is left out unseen: small integers, short fractions, hinted paths."""
    numbers = [0, 7, -9999999, 9999999, 10_000_000, -10_000_000, 123456789, 4111111111111111, -5551234567, None]
    rows = [
        (i, n, n, n if n is None else n / 1000, None if n is None else float(n) * 1e9, f" Ann Lee{i}" if i % 2 else "ann@x.com ", bytearray(b" 10.1.2.3 "))
        for i, n in enumerate(numbers)
    ]
    df = spark.createDataFrame(rows, "k long, number long, address_no long, rate double, file_name double, note string, raw binary")
    df = df.withColumns({"paid": F.expr("cast(number as decimal(20, 0))"), "at": F.expr("timestamp'2024-01-15 12:00:00'"), "day": F.expr("date'2024-01-15'")})
    found = lambda rows, **how: sorted(map(tuple, detect_fields(rows, TYPE_NAMES, **how).collect()))
    plain = ops.cell_rows(ops.table_cells(df, "t", "k"))
    searched = ops.cell_rows(ops.table_cells(df, "t", "k", searched=True), searched=True)
    assert found(searched) == found(plain) == found(searched, screen=False)
    left = {(r["offset"], r["field_path"]) for r in searched.collect()}
    assert not left & {(o, p) for o in (0, 1, 2, 3, 9) for p in ("k", "number", "rate")}
