"""Registered queries: every operator of the engine over the provided tables, whole tables each."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelight.functions.text import mask, normalize_path, sanitize_field_name
from tracelight.operators import classify as C
from tracelight.operators import detect as D
from tracelight.operators import fields as FL
from tracelight.operators import providers as V
from tracelight.operators import sampling as L
from tracelight.operators import spans as S
from tracelight.operators import tagging as G
from tracelight.operators.skew import stored_side
from tracelight.plans.run import RunOptions, analyze
from tracelight.schemas import TYPE_NAMES
from tracelight.session import prepare_session, scratch_path, shared_folder
from tracelight.sources import catalog as K
from tracelight.sources import messages as M
from tracelight.sources import reports as R
from tracelight.sources.tables import read_table, spread
from tracelight.streaming import classify as WC
from tracelight.streaming import detect as W
from tracelight.streaming import streaks as WS

# Field paths given to the words of documents, so that every kind of path context occurs.
WORD_PATHS = [
    "note", "contact_email", "card_number", "client_ip", "created_at", "message",
    "home_address", "full_name", "aws_secret_key", "birth_date", "phone", "license_plate",
]

# Tables read as topics, with the expression that identifies a row. A second number takes 31 bits.
TABLE_KEYS = {
    "orders": "o_orderkey",
    "customer": "c_custkey",
    "supplier": "s_suppkey",
    "part": "p_partkey",
    "nation": "cast(n_nationkey as bigint)",
    "region": "cast(r_regionkey as bigint)",
    "events": "event_id",
    "lineitem": "l_orderkey * 2147483648 + l_linenumber",
}


_tables: dict[tuple, DataFrame] = {}

# Session setting: tasks that the provided tables are dealt to. Unset, they stay in their scan's partitions.
PARTITIONS_CONF = "spark.tracelight.readPartitions"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A provided table; its footer is read once per application."""
    partitions = spark.conf.get(PARTITIONS_CONF, None)
    key = (spark.sparkContext.applicationId, sf, name, partitions)
    if key not in _tables:
        number = int(partitions) if partitions else None
        _tables[key] = read_table(prepare_session(spark), f"{sf}/{name}.parquet", partitions=number)
    return _tables[key]


def topic_cells(spark: SparkSession, sf: str, name: str, searched: bool = False) -> DataFrame:
    df = table(spark, sf, name)
    return FL.table_cells(df.withColumn("_key", F.expr(TABLE_KEYS[name])), name, "_key", columns=df.columns, searched=searched)


def topic_fields(spark: SparkSession, sf: str, *names: str, searched: bool = False) -> DataFrame:
    cells = topic_cells(spark, sf, names[0], searched)
    for name in names[1:]:
        cells = cells.unionByName(topic_cells(spark, sf, name, searched))
    return FL.cell_rows(cells, searched)


def all_table_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Fields of all tables that may hold a finding."""
    return topic_fields(spark, sf, *TABLE_KEYS, searched=True)


def word_fields(spark: SparkSession, sf: str) -> DataFrame:
    paths = ", ".join(f"'{p}'" for p in WORD_PATHS)
    docs = table(spark, sf, "documents").select(
        F.col("doc_id"),
        F.expr(f"array({paths})[cast(pmod(doc_id, {len(WORD_PATHS)}) as int)]").alias("field_path"),
        F.posexplode(F.split("text", r"\s+")).alias("pos", "value"),
    )
    return docs.select(
        F.lit("words").alias("topic"),
        F.pmod("doc_id", F.lit(3)).cast("int").alias("partition"),
        (F.col("doc_id") * (1 << 31) + F.col("pos")).alias("offset"),
        "field_path",
        F.lit("string").alias("value_type"),
        "value",
    )


def sentence_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Lines and sentences of all documents, one topic for each language."""
    return FL.text_fields(table(spark, sf, "documents"), F.col("lang"), "doc_id", "text")


# Fields made from the digits ``d`` of a key, their letters ``l`` and hash ``h``: a value of every type, on paths with
# and without a hint. The text is SQL of Spark and DuckDB alike.
_SSN = "substring(d, 1, 3) || '-' || substring(d, 4, 2) || '-' || substring(d, 6, 4)"
_CARD = "'4111' || substring(d, 1, 4) || substring(d, 5, 4) || substring(d, 2, 4)"
_BIRTH = "'198' || substring(d, 1, 1) || '-0' || cast(n % 9 + 1 as string) || '-1' || substring(d, 2, 1)"
_PERSON = "substring(l, 1, 1) || lower(substring(l, 2, 4)) || ' ' || substring(l, 5, 1) || lower(substring(l, 6, 4))"
_MAC = " || ':' || ".join(f"substring(h, {2 * i + 1}, 2)" for i in range(6))
TYPE_FIELDS = [
    ("person.ssn", _SSN), ("code", _SSN), ("tax_ssn", "'666-' || substring(d, 4, 2) || '-' || substring(d, 6, 4)"),
    ("number", "d"), ("itin", "'9' || substring(d, 1, 2) || '7' || substring(d, 3, 5)"),
    ("tax_code", "'9' || substring(d, 1, 2) || '8' || substring(d, 3, 5)"),
    ("contact.email", "lower(l) || '@example.com'"), ("note", "lower(l) || '@example.com'"),
    ("work_phone", "'(' || substring(d, 1, 3) || ') ' || substring(d, 4, 3) || '-' || substring(d, 6, 4)"),
    ("event_time", "'17' || d"), ("reference", "'+1 ' || substring(d, 1, 3) || ' 555 ' || substring(d, 6, 4)"),
    ("card_number", _CARD), ("payment_date", _CARD), ("birth_date", _CARD),
    ("remark", "'4111 ' || substring(d, 1, 4) || ' ' || substring(d, 5, 4) || ' ' || substring(d, 2, 4)"),
    ("client_ip", "cast(n % 256 as string) || '.10.' || cast(n % 100 as string) || '.7'"),
    ("person.dob", _BIRTH), ("created_at", _BIRTH), ("customer_id", _BIRTH),
    ("full_name", _PERSON), ("label", _PERSON), ("license_plate", _PERSON),
    ("long_name", f"{_PERSON} || ' ' || {_PERSON} || ' ' || {_PERSON}"),
    ("title", f"{_PERSON} || ' ' || {_PERSON} || ' ' || {_PERSON}"),
    ("bank_account", "d || substring(d, 1, 3)"), ("iban", "'GB' || substring(d, 1, 2) || 'WEST' || d"),
    ("document", "'DE' || substring(d, 1, 2) || d || d"), ("swift_code", "substring(l, 1, 8)"), ("branch", "l || 'XX'"),
    ("aws_access_key", "'AKIA' || l || substring(l, 1, 7)"), ("key", "'AKIA' || l || substring(l, 1, 7)"),
    ("aws_secret", "h || substring(h, 1, 8)"), ("digest", "h || substring(h, 1, 8)"),
    ("national_insurance", "'AB' || substring(d, 1, 6) || 'C'"), ("member", "'AB' || substring(d, 1, 6)"),
    ("mac_address", _MAC), ("device", _MAC), ("home_address", "substring(d, 1, 3) || ' Main Street'"), ("first_name", "lower(l)"),
]


def type_fields(spark: SparkSession, sf: str) -> DataFrame:
    """``TYPE_FIELDS`` of every customer."""
    keys = spread(table(spark, sf, "customer").selectExpr("c_custkey as n")).selectExpr(
        "n", "lpad(cast(n * 179424673 % 1000000000 as string), 9, '0') as d"
    ).selectExpr("n", "d", "translate(d, '0123456789', 'ABCDEFGHIJ') as l", "md5(cast(d as binary)) as h")
    cells = ", ".join(f"struct('{path}' as field_path, {value} as value)" for path, value in TYPE_FIELDS)
    return keys.select("n", F.expr(f"posexplode(array({cells}))").alias("pos", "cell")).select(
        F.lit("types").alias("topic"),
        F.pmod("n", F.lit(3)).cast("int").alias("partition"),
        (F.col("n") * 64 + F.col("pos")).alias("offset"),
        "cell.field_path",
        F.lit("string").alias("value_type"),
        "cell.value",
    )


# Paths and values on which findings of other providers meet, and the types they report.
RULE_PATHS = [
    "event_time", "license_plate", "payment_date", "customer_id", "birth_date", "remark", "card_number", "home_address",
]
RULE_VALUES = ["'17' || d", "'17' || d || '.25'", "'1985-04-1' || substring(d, 1, 1)", "'Ann ' || d", "d"]
RULE_TYPES = [
    "PHONE_NUMBER", "DATE_OF_BIRTH", "CREDIT_CARD", "DRIVER_LICENSE", "NAME",
    "ADDRESS", "BANK_ACCOUNT", "SSN", "IBAN", "USERNAME",
]


def rule_findings(spark: SparkSession, sf: str) -> DataFrame:
    """Findings of any types and confidences about one value, for each order: every rule applies somewhere."""
    paths = ", ".join(f"'{p}'" for p in RULE_PATHS)
    types = ", ".join(f"'{t}'" for t in RULE_TYPES)
    orders = table(spark, sf, "orders").selectExpr("o_orderkey as n", "o_orderkey * 179424673 % 1000000000 as x")
    digits = orders.withColumn("d", F.expr("lpad(cast(x as string), 9, '0')"))
    values = digits.selectExpr(
        "n", "x", f"element_at(array({paths}), cast(n % {len(RULE_PATHS)} as int) + 1) as field_path",
        f"element_at(array({', '.join(RULE_VALUES)}), cast(floor(n / {len(RULE_PATHS)}) % {len(RULE_VALUES)} as int) + 1) as value",
    )
    said = values.select("*", F.expr(f"posexplode(array({types}))").alias("i", "pii_type")).where("shiftright(x, i) & 1 = 1")
    return said.select(
        F.lit("rules").alias("topic"),
        F.pmod("n", F.lit(3)).cast("int").alias("partition"),
        F.col("n").alias("offset"),
        "field_path",
        "pii_type",
        F.expr("cast((x + i * 7919) % 20 as double) / 20").alias("confidence"),
        "value",
        F.col("value").alias("pattern_matched"),
        F.lit("model").alias("provider"),
        F.col("i").alias("seq"),
    )


def all_totals(spark: SparkSession, sf: str, *names: str) -> DataFrame:
    """Messages per topic: rows of each table, and words of the documents if no table is named."""
    cells = None
    for name in names or TABLE_KEYS:
        one = topic_cells(spark, sf, name)
        cells = one if cells is None else cells.unionByName(one)
    totals = M.topic_totals(cells)
    if names:
        return totals
    words = table(spark, sf, "documents").agg(F.sum(F.size(F.split("text", r"\s+"))).alias("total_samples"))
    return totals.unionByName(words.select(F.lit("words").alias("topic"), "total_samples"))


def event_messages(spark: SparkSession, sf: str, value: Column | None = None) -> DataFrame:
    """Events as messages: the event type is the topic, the id gives partition and offset."""
    body = value if value is not None else F.col("props")
    return table(spark, sf, "events").select(
        F.col("event_type").alias("topic"),
        F.pmod("event_id", F.lit(3)).cast("int").alias("partition"),
        F.col("event_id").alias("offset"),
        F.lit(None).cast("binary").alias("key"),
        body.cast("binary").alias("value"),
        F.col("ts").alias("timestamp"),
        F.lit(None).cast("array<struct<key:string,value:binary>>").alias("headers"),
    )


NESTED_EVENT = (
    "concat('{\"u\":{\"id\":', user_id, ',\"t\":[\"', event_type, '\",[', event_id, ',7]]},\"p\":', props, "
    "',\"e\":{},\"n\":null}')"
)
LIST_EVENT = "concat('[{\"id\":', event_id, '},[\"', event_type, '\",[', user_id, ',{\"k\":', props, '}]]]')"


def profile_messages(spark: SparkSession, sf: str) -> DataFrame:
    """One JSON message per document: all emails, phones, cards and addresses in its whole text.

    The first of a kind has a field of its own, later ones are items of a list. The language is the
    topic. Documents whose id ends in 7 carry their text without JSON around it.
    """
    kinds = ("EMAIL", "PHONE_NUMBER", "CREDIT_CARD", "IP_ADDRESS")
    # each pattern once a text, in a step of its own
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source", *[S.text_matches(F.col("text"), t).alias(t) for t in kinds])
    first = lambda t: F.get(t, F.lit(0))
    later = lambda t: F.slice(t, 2, F.greatest(F.size(t), F.lit(1)))
    contact = F.struct(
        first("EMAIL").alias("email"), first("PHONE_NUMBER").alias("phone"),
        later("EMAIL").alias("emails"), later("PHONE_NUMBER").alias("phones"),
    )
    body = F.to_json(
        F.struct(
            "doc_id",
            contact.alias("contact"),
            F.transform("CREDIT_CARD", lambda c: F.struct(c.alias("card_number"))).alias("payment"),
            first("IP_ADDRESS").alias("client_ip"),
            later("IP_ADDRESS").alias("proxy_ips"),
            "source",
        )
    )
    plain = F.col("doc_id") % 10 == 7
    return docs.select(
        F.col("lang").alias("topic"),
        F.pmod("doc_id", F.lit(3)).cast("int").alias("partition"),
        F.col("doc_id").alias("offset"),
        F.lit(None).cast("binary").alias("key"),
        F.when(plain, F.col("source")).otherwise(body).cast("binary").alias("value"),
        F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, doc_id)").alias("timestamp"),
        F.lit(None).cast("array<struct<key:string,value:binary>>").alias("headers"),
    )


def part_catalog(spark: SparkSession, sf: str) -> DataFrame:
    """A schema catalog out of the part table: the brand is the subject, the key the version."""
    return table(spark, sf, "part").select(
        F.concat("p_brand", F.lit("-value")).alias("subject"),
        F.col("p_partkey").cast("int").alias("version"),
        (F.col("p_partkey") + 1000).cast("int").alias("schema_id"),
        F.when(F.col("p_type") != "ECONOMY", F.col("p_type")).alias("schema_type"),
        F.col("p_name").alias("schema"),
        F.lit(None).cast("timestamp").alias("registered_at"),
    )


# Queries over topics and sources ---------------------------------------------------------------


def q_topic_profile(spark, sf):
    parts = [M.to_messages(table(spark, sf, t), t, k) for t, k in
             [("orders", "o_orderkey"), ("customer", "c_custkey"), ("events", "event_id")]]
    return M.partition_profile(parts[0].unionByName(parts[1]).unionByName(parts[2]))


def q_to_messages(spark, sf):
    msgs = M.to_messages(table(spark, sf, "orders"), "orders", "o_orderkey", n_partitions=4)
    return msgs.select("topic", "partition", "offset", F.col("key").cast("string").alias("key"),
                       F.col("value").cast("string").alias("value"))


def q_sparse_keys(spark, sf):
    """Dense offsets of keys that lie far apart and in clusters."""
    # beyond three million orders the products no longer fit 64 bits
    square = "cast(cast(o_orderkey as decimal(38, 0)) * o_orderkey as decimal(38, 0))"
    orders = table(spark, sf, "orders").selectExpr("o_orderkey", f"cast({square} * 1000003 as decimal(38, 0)) as wide")
    msgs = M.to_messages(orders, "orders", "wide", n_partitions=2, ranges=16)
    return msgs.select("partition", "offset", F.col("value").cast("string").alias("value"))


def q_read_messages(spark, sf):
    """Store all events by topic, then read two topics back."""
    path = scratch_path(spark, "messages")
    M.write_messages(event_messages(spark, sf), path)
    msgs = M.read_messages(spark, path, topics=["click", "error"])
    return msgs.select("topic", "partition", "offset", F.col("value").cast("string").alias("value"))


def q_list_topics(spark, sf):
    return M.list_topics(event_messages(spark, sf), "c|err")


def _named_topics(spark, sf):
    name = "concat(case when doc_id % 7 = 0 then '_' when doc_id % 11 = 0 then '__transaction_state-' else '' end, source)"
    return table(spark, sf, "documents").select(F.expr(name).alias("topic"))


def q_resolve_topics(spark, sf):
    return M.resolve_topics(_named_topics(spark, sf), exclude_patterns=["^_", "c1[0-4]$", "7("])


def q_default_topics(spark, sf):
    return M.resolve_topics(_named_topics(spark, sf))


def q_exclude_listed(spark, sf):
    listed = table(spark, sf, "documents").where("n_chars > 15000").select(F.col("source").alias("topic"))
    return M.exclude_listed(M.list_topics(_named_topics(spark, sf)), listed)


def q_empty_topics(spark, sf):
    names = table(spark, sf, "events").select(F.col("event_type").alias("topic")).unionByName(
        table(spark, sf, "part").select(F.col("p_brand").alias("topic"))
    )
    return M.empty_topics(names, event_messages(spark, sf))


def q_flag_schemaless(spark, sf):
    names = table(spark, sf, "part").select(F.col("p_brand").alias("topic")).unionByName(
        table(spark, sf, "customer").select(F.col("c_mktsegment").alias("topic"))
    )
    return M.flag_schemaless(names.distinct(), part_catalog(spark, sf))


def q_latest_schema(spark, sf):
    return K.latest_schema(part_catalog(spark, sf)).select("subject", "version", "schema_id", "schema")


def q_schema_lookup(spark, sf):
    catalog = part_catalog(spark, sf)
    exact = K.schema_as_of(catalog, "Brand#17-value", 1).withColumn("how", F.lit("version"))
    by_id = K.schema_by_id(catalog, 1005).withColumn("how", F.lit("id"))
    return exact.unionByName(by_id).select("how", "subject", "version", "schema_id", "schema")


def q_schema_exists(spark, sf):
    names = table(spark, sf, "customer").select(F.concat("c_mktsegment", F.lit("-value")).alias("subject")).unionByName(
        part_catalog(spark, sf).select("subject")
    )
    return K.schema_exists(names.distinct(), part_catalog(spark, sf))


def q_list_subjects(spark, sf):
    return K.list_subjects(part_catalog(spark, sf))


def q_register_schemas(spark, sf):
    """Next versions for all market segments and all brands."""
    new = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("name")).unionByName(
        table(spark, sf, "part").select(F.col("p_brand").alias("name"))
    ).distinct().select(
        F.concat("name", F.lit("-value")).alias("subject"), F.col("name").alias("schema"),
        F.lit(None).cast("string").alias("schema_type"),
    )
    return K.new_versions(part_catalog(spark, sf), new).drop("registered_at")


# Decoding and fields -----------------------------------------------------------------------------


def _framed_events(spark, sf):
    """Framed JSON, plain JSON, JSON behind a binary prefix, cut JSON, an empty record, by turns."""
    body = F.expr(
        """case pmod(event_id, 5)
             when 0 then concat(unhex('00'), unhex(lpad(hex(user_id), 8, '0')), cast(props as binary))
             when 1 then cast(props as binary)
             when 2 then concat(unhex('FFFE01'), cast(props as binary))
             when 3 then cast(concat(props, ' tail') as binary)
             else cast('{}' as binary) end"""
    )
    return event_messages(spark, sf, body)


def q_wire_format(spark, sf):
    rows = FL.split_wire_format(_framed_events(spark, sf))
    return rows.select("topic", "offset", "framed", "schema_id", F.length("payload").alias("payload_bytes"))


def q_parse_json_lenient(spark, sf):
    return FL.parse_json_lenient(_framed_events(spark, sf)).select("topic", "offset", "json")


def q_decode_records(spark, sf):
    catalog = part_catalog(spark, sf).withColumn("schema_id", F.col("schema_id") - 1000)
    decoders = {"PROMO": lambda payload: F.get_json_object(payload.cast("string"), "$.k")}
    rows = FL.decode_records(_framed_events(spark, sf), catalog, decoders)
    return rows.select("topic", "offset", "json")


def q_flatten_json_fields(spark, sf):
    parsed = FL.parse_json_lenient(event_messages(spark, sf, F.expr(NESTED_EVENT)))
    return FL.flatten(parsed).drop("partition")


def q_extract_json_fields(spark, sf):
    parsed = FL.parse_json_lenient(event_messages(spark, sf, F.expr(LIST_EVENT)))
    return FL.extract_fields(parsed).drop("partition")


def q_extract_to_depth(spark, sf):
    parsed = FL.parse_json_lenient(event_messages(spark, sf, F.expr(LIST_EVENT)))
    return FL.extract_fields(parsed, max_depth=2).drop("partition")


def q_field_universe(spark, sf):
    parsed = FL.parse_json_lenient(event_messages(spark, sf, F.expr(NESTED_EVENT)))
    return FL.field_universe(FL.flatten(parsed))


def q_infer_schema(spark, sf):
    inferred = FL.infer_schema(FL.extract_fields(FL.parse_json_lenient(event_messages(spark, sf, F.expr(NESTED_EVENT)))))
    return inferred.withColumn("sample_values", F.array_join("sample_values", "|"))


def q_sanitize_names(spark, sf):
    return table(spark, sf, "pages").select("page_id", sanitize_field_name(F.col("url")).alias("name"))


def q_normalize_paths(spark, sf):
    rows = q_extract_json_fields(spark, sf).select(normalize_path(F.col("field_path")).alias("path"))
    return rows.groupBy("path").agg(F.count(F.lit(1)).alias("n"))


def q_stringify(spark, sf):
    padded = F.concat(F.lit(" \t"), F.col("p_name"), F.lit(" \n"))
    return table(spark, sf, "part").select("p_partkey", FL.stringify(padded).alias("name"), FL.stringify(F.col("p_size")).alias("size"))


# Sampling ----------------------------------------------------------------------------------------


def _picked(df):
    return df.select("topic", "partition", "offset")


def q_sample_tail(spark, sf):
    return _picked(L.tail_per_partition(event_messages(spark, sf), 50))


def q_sample_percentage(spark, sf):
    return _picked(L.sample_percentage(event_messages(spark, sf), 5))


def q_sample_percentage_uncapped(spark, sf):
    return _picked(L.sample_percentage(event_messages(spark, sf), 10, 10, 100, read_cap=None))


def q_sample_percentage_capped(spark, sf):
    return _picked(L.sample_percentage(event_messages(spark, sf), 5, 10, 1000, read_cap=L.READ_CAP))


def q_sample_nth(spark, sf):
    return _picked(L.sample(event_messages(spark, sf), "every_nth", percentage=5))


def q_sample_nth_capped(spark, sf):
    return _picked(L.sample_every_nth(event_messages(spark, sf), 5, 1000, read_cap=L.READ_CAP))


def q_sample_count(spark, sf):
    return _picked(L.sample_count(event_messages(spark, sf), 500))


def q_sample_count_capped(spark, sf):
    return _picked(L.sample_count(event_messages(spark, sf), 30, compat_caps=True))


def q_sample_all_capped(spark, sf):
    return _picked(L.sample_all(event_messages(spark, sf), compat_caps=True))


def q_sample_time_window(spark, sf):
    return _picked(L.sample_time_window(event_messages(spark, sf), "36h", "2024-01-15 12:00:00"))


def q_sample_first_partitions(spark, sf):
    return _picked(L.limit_partitions(event_messages(spark, sf), 2))


def q_sample_bernoulli(spark, sf):
    return _picked(L.bernoulli_fill(event_messages(spark, sf), 10))


def q_sample_bernoulli_capped(spark, sf):
    return _picked(L.bernoulli_fill(event_messages(spark, sf), 10, 10, 40))


def q_target_sample_counts(spark, sf):
    profile = M.partition_profile(event_messages(spark, sf))
    union = None
    for strategy in ("all", "percentage", "count", "time_based"):
        rows = L.target_sample_count(profile, strategy, min_per_partition=10, max_per_partition=40)
        rows = rows.withColumn("strategy", F.lit(strategy))
        union = rows if union is None else union.unionByName(rows)
    return union


# Detection ---------------------------------------------------------------------------------------

_FOUND = ["topic", "offset", "field_path", "pii_type", "confidence", "value", "pattern_matched"]


def q_detect_values(spark, sf):
    return D.detect_pattern(word_fields(spark, sf)).select(*_FOUND)


def q_detect_tables(spark, sf):
    return D.detect_pattern(all_table_fields(spark, sf)).select(*_FOUND)


def q_resolve_conflicts(spark, sf):
    return D.detect_fields(word_fields(spark, sf), TYPE_NAMES).select(*_FOUND)


def q_resolve_grouped(spark, sf):
    """The same findings by the way of several providers: grouped by value, then resolved."""
    return D.resolve_findings(D.detect_pattern(word_fields(spark, sf)), TYPE_NAMES).select(*_FOUND)


def q_detect_core_types(spark, sf):
    return D.detect_fields(word_fields(spark, sf)).select(*_FOUND)


def q_detect_two_types(spark, sf):
    return D.filter_enabled(D.detect_pattern(word_fields(spark, sf)), ["EMAIL", "IP_ADDRESS"]).select(*_FOUND)


def q_detect_dates(spark, sf):
    orders = table(spark, sf, "orders")
    stamp = F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
    renamed = orders.select("o_orderkey", *[stamp.alias(n) for n in ("o_orderdate", "event_time", "birth_id", "payment_date")])
    return D.detect_fields(FL.table_fields(renamed, "orders", "o_orderkey"), TYPE_NAMES).select(*_FOUND)


def q_detect_sentences(spark, sf):
    return D.detect_pattern(sentence_fields(spark, sf)).select(*_FOUND)


def q_resolve_sentences(spark, sf):
    return D.detect_fields(sentence_fields(spark, sf), TYPE_NAMES).select(*_FOUND)


def q_detect_all_types(spark, sf):
    """Raw findings of all fifteen patterns and both hints."""
    return D.detect_pattern(type_fields(spark, sf)).select(*_FOUND)


def q_resolve_all_types(spark, sf):
    return D.detect_fields(type_fields(spark, sf), TYPE_NAMES).select(*_FOUND)


def q_resolve_all_rules(spark, sf):
    """All conflict rules over findings of another provider."""
    return D.resolve_findings(rule_findings(spark, sf), TYPE_NAMES).select(*_FOUND)


def q_classify_type_fields(spark, sf):
    fields = type_fields(spark, sf)
    return _joined(C.classify_values(fields, M.topic_totals(fields), _LOW, TYPE_NAMES))


def q_dedupe_findings(spark, sf):
    """Two providers report the same findings, one of them less sure."""
    found = D.detect_pattern(word_fields(spark, sf)).withColumn("seq", F.col("hit_no"))
    # both reports of a finding come out of one search of the words
    second = F.struct(
        F.lit("second").alias("provider"), F.lit(1).alias("provider_no"),
        F.when(F.col("offset") % 2 == 0, 0.99).otherwise(0.1).alias("confidence"),
    )
    first = F.struct("provider", F.lit(0).alias("provider_no"), "confidence")
    kept = [c for c in found.columns if c not in ("provider", "confidence")]
    return D.dedupe(found.select(*kept, F.inline(F.array(first, second)))).select(*_FOUND, "provider")


def q_detect_messages(spark, sf):
    return D.detect_messages(profile_messages(spark, sf)).select(*_FOUND)


def q_message_types(spark, sf):
    rows = D.message_types(profile_messages(spark, sf))
    return rows.select("topic", "offset", F.array_join("pii_types", ",").alias("pii_types"))


# Classification ----------------------------------------------------------------------------------


def _joined(cls: DataFrame) -> DataFrame:
    lists = {c: F.array_join(c, "|") for c in ("pii_types", "tags", "sample_values")}
    return cls.withColumns(lists).withColumns(
        {"confidence": F.round("confidence", 6), "detection_rate": F.round("detection_rate", 6)}
    )


def _candidates(spark, sf) -> DataFrame:
    """Words and table fields that may hold a finding."""
    return D.screened(word_fields(spark, sf)).unionByName(all_table_fields(spark, sf))


def _classified(spark, sf, thresholds=C.Thresholds(), enabled=None) -> DataFrame:
    return C.classify_values(_candidates(spark, sf), all_totals(spark, sf), thresholds, enabled, screen=False)


def _stored_classes(spark, sf) -> DataFrame:
    """Classifications computed once, for queries that read them in several jobs or branches."""
    return stored_side(_classified(spark, sf), "classified")


def q_classify_findings(spark, sf):
    """The same classification from finding rows, as needed for several providers."""
    found = D.detect_fields(_candidates(spark, sf), screen=False)
    return _joined(C.classify_fields(found, all_totals(spark, sf)))


def q_classify_texts(spark, sf):
    """The text of each language as one field: all its lines and sentences."""
    fields = sentence_fields(spark, sf).withColumn("field_path", normalize_path(F.col("field_path")))
    totals = table(spark, sf, "documents").groupBy(F.col("lang").alias("topic")).agg(F.count(F.lit(1)).alias("total_samples"))
    # Numbers of findings hold for single items; without them one for each text is counted.
    return _joined(C.classify_fields(D.detect_fields(fields, TYPE_NAMES).drop("hit_no"), totals, _TEXTS))


# A few of all documents hold a value.
_TEXTS = C.Thresholds(confidence=0.5, min_rate=0.0, require_multiple=True)
# Word fields are one of twelve paths each, so their share of all words is small.
_LOW = C.Thresholds(confidence=0.6, min_rate=0.0, require_multiple=True)


def q_classify_fields(spark, sf):
    return _joined(_classified(spark, sf))


def q_classify_all_types(spark, sf):
    return _joined(_classified(spark, sf, _LOW, TYPE_NAMES))


def q_type_stats(spark, sf):
    stats = C.type_stats(D.detect_fields(word_fields(spark, sf), TYPE_NAMES))
    return stats.withColumn("type_confidence", F.round("type_confidence", 6))


def q_detection_rates(spark, sf):
    fields = word_fields(spark, sf)
    rates = C.detection_counts(D.detect_fields(fields, TYPE_NAMES), M.topic_totals(fields))
    return rates.withColumn("detection_rate", F.round("detection_rate", 9))


def q_sample_values(spark, sf):
    rows = C.sample_values(D.detect_fields(word_fields(spark, sf), TYPE_NAMES))
    return rows.withColumn("sample_values", F.array_join("sample_values", "|"))


def _summary(spark, sf):
    totals = all_totals(spark, sf)
    names = totals.select("topic").unionByName(table(spark, sf, "documents").select(F.col("source").alias("topic")))
    return C.topic_summary(_classified(spark, sf), totals, names)


def q_topic_summary(spark, sf):
    return _summary(spark, sf)


def q_triage_topics(spark, sf):
    return C.triage_topics(_summary(spark, sf))


def q_run_summary(spark, sf):
    errors = table(spark, sf, "documents").where("n_chars > 15000").select(F.col("source").alias("topic"))
    return C.run_summary(_summary(spark, sf), errors)


def q_tags_summary(spark, sf):
    return C.tags_summary(_classified(spark, sf, _LOW, TYPE_NAMES))


def q_risk_rollup(spark, sf):
    return C.risk_rollup(_classified(spark, sf, _LOW, TYPE_NAMES))


def q_detection_summary(spark, sf):
    docs = word_fields(spark, sf).withColumn("doc_id", F.shiftright("offset", 31))
    det = D.detect_fields(docs, TYPE_NAMES, keep=["doc_id"])
    rows = C.detection_summary(det, table(spark, sf, "documents"), by=["doc_id"])
    return rows.withColumn("pii_types", F.array_join("pii_types", ","))


def q_high_risk_docs(spark, sf):
    docs = word_fields(spark, sf).withColumn("doc_id", F.shiftright("offset", 31))
    return C.high_risk(D.detect_fields(docs, TYPE_NAMES, keep=["doc_id"]), by=["doc_id"])


def q_classification_metrics(spark, sf):
    """A run log with one row per day of events."""
    log = table(spark, sf, "events").groupBy(F.to_date("ts").alias("day")).agg(
        F.countDistinct("event_type").alias("topics_analyzed"),
        F.sum((F.col("event_type") == "error").cast("long")).alias("total_pii_fields"),
        F.max("ts").alias("finished_at"),
    )
    return C.classification_metrics(log)


def q_analyze_messages(spark, sf):
    """The whole batch run over JSON messages."""
    result = analyze(profile_messages(spark, sf), options=RunOptions(thresholds=C.Thresholds(0.5, 0.0, True)))
    return _joined(result.classifications)


def list_messages(spark: SparkSession, sf: str) -> DataFrame:
    """One JSON message per document with arrays of all emails, addresses and cards of its whole text."""
    every = lambda t: F.regexp_extract_all("text", F.lit(S.SPAN_PATTERNS[t]), F.lit(0))
    contacts = F.transform(every("EMAIL"), lambda e: F.struct(e.alias("email")))
    body = F.struct("doc_id", contacts.alias("contacts"), every("IP_ADDRESS").alias("client_ip"), every("CREDIT_CARD").alias("cards"))
    return table(spark, sf, "documents").select(
        F.col("lang").alias("topic"),
        F.pmod("doc_id", F.lit(3)).cast("int").alias("partition"),
        F.col("doc_id").alias("offset"),
        F.lit(None).cast("binary").alias("key"),
        F.to_json(body).cast("binary").alias("value"),
        F.lit(None).cast("timestamp").alias("timestamp"),
        F.lit(None).cast("array<struct<key:string,value:binary>>").alias("headers"),
    )


def q_classify_arrays(spark, sf):
    """The whole batch run with all items of an array as one field."""
    options = RunOptions(thresholds=C.Thresholds(0.5, 0.0, False), normalize_paths=True)
    return _joined(analyze(list_messages(spark, sf), options=options).classifications)


# Reports and free text ---------------------------------------------------------------------------


def q_report_rows(spark, sf):
    return R.report_rows(_classified(spark, sf, _LOW, TYPE_NAMES))


def q_masked_samples(spark, sf):
    rows = R.masked_samples(_classified(spark, sf, _LOW, TYPE_NAMES))
    return rows.select("topic", "field_path", F.array_join("sample_values", "|").alias("sample_values"))


def q_topic_reports(spark, sf):
    cls = _stored_classes(spark, sf)
    rows = R.topic_reports(C.topic_summary(cls, all_totals(spark, sf)), cls)
    paths = F.coalesce(F.array_join("classifications.field_path", ","), F.lit(""))
    return rows.select("topic", "samples", "pii_fields_found", paths.alias("classified"))


def q_write_report(spark, sf):
    """The topics of a written JSON report, read back."""
    cls = _stored_classes(spark, sf)
    summary = C.topic_summary(cls, all_totals(spark, sf))
    target = R.write_report(summary, cls, scratch_path(spark, "reports"))
    rows = spark.read.schema(R.topic_reports(summary, cls).schema).json(f"{target}/topics")
    paths = F.coalesce(F.array_join("classifications.field_path", ","), F.lit(""))
    return rows.select("topic", "samples", "pii_fields_found", paths.alias("classified"))


def q_find_spans(spark, sf):
    return S.find_spans(table(spark, sf, "documents"), "text", ["doc_id"])


def q_resolve_spans(spark, sf):
    return S.resolve_spans(table(spark, sf, "documents"), "text", ["doc_id"])


def q_resolve_spans_pages(spark, sf):
    return S.resolve_spans(table(spark, sf, "pages"), "html", ["page_id"])


def q_find_spans_pages(spark, sf):
    return S.find_spans(table(spark, sf, "pages"), "html", ["page_id"])


def q_find_spans_conversations(spark, sf):
    return S.find_spans(table(spark, sf, "conversations"), "text", ["conv_id", "turn"])


def q_luhn_cards(spark, sf):
    return S.luhn_cards(table(spark, sf, "documents"), "text", ["doc_id"])


def q_redact_text(spark, sf):
    return S.redact_text(table(spark, sf, "documents"), "text").select("doc_id", "text")


def q_redact_pages(spark, sf):
    return S.redact_text(table(spark, sf, "pages"), "html").select("page_id", "html")


def q_mask_text(spark, sf):
    types = ["EMAIL", "CREDIT_CARD", "IP_ADDRESS"]
    return S.redact_text(table(spark, sf, "documents"), "text", types, "mask").select("doc_id", "text")


def q_mask_values(spark, sf):
    return table(spark, sf, "customer").select(
        "c_custkey", mask(F.col("c_name")).alias("hidden"), mask(F.col("c_name"), 4).alias("partly"),
        mask(F.col("c_mktsegment"), 9).alias("segment"),
    )


def q_mask_classified(spark, sf):
    cls = C.classify_values(topic_fields(spark, sf, "orders"), all_totals(spark, sf, "orders"))
    return S.mask_classified(table(spark, sf, "orders"), cls, "orders", 4).select("o_orderkey", "o_orderdate", "o_orderstatus")


# Providers ---------------------------------------------------------------------------------------


def q_normalize_findings(spark, sf):
    docs = table(spark, sf, "documents").select(
        "doc_id",
        F.expr("array('aws', 'gcp', 'azure', 'presidio', 'model')[cast(pmod(doc_id, 5) as int)]").alias("provider"),
        F.expr(
            "array('EMAIL', 'PERSON_NAME', 'IPAddress', 'LOCATION', 'dob', 'UNKNOWN', 'IBAN_CODE')"
            "[cast(pmod(doc_id, 7) as int)]"
        ).alias("entity"),
    )
    return V.normalize_findings(docs).select("doc_id", "provider", "pii_type")


def q_likelihood(spark, sf):
    words = "array('VERY_UNLIKELY', 'UNLIKELY', 'POSSIBLE', 'LIKELY', 'VERY_LIKELY', 'OTHER')[cast(pmod(doc_id, 6) as int)]"
    return table(spark, sf, "documents").select(
        "doc_id", V.likelihood_to_confidence(F.expr(words)).alias("confidence")
    )


def q_slice_spans(spark, sf):
    docs = table(spark, sf, "documents").select(
        "doc_id", "text",
        F.expr("if(doc_id % 4 = 0, null, cast(doc_id % 50 as int))").alias("begin"),
        F.expr("if(doc_id % 5 = 0, null, cast(doc_id % 50 + 12 as int))").alias("end"),
    )
    return V.slice_spans(docs).select("doc_id", "value")


def q_whole_value_spans(spark, sf):
    found = table(spark, sf, "customer").select(
        "c_custkey", F.lit("c_name").alias("field_path"), F.col("c_name").alias("field_value"),
        F.expr("cast(array(0, 8, 9)[cast(c_custkey % 3 as int)] as int)").alias("begin"),
        (F.length("c_name") + 8).alias("end"),
    )
    return V.keep_whole_value_spans(found).select("c_custkey", "value", "pattern_matched")


def _uncovered(spark, sf):
    fields = topic_fields(spark, sf, "orders", "customer")
    return fields, V.uncovered_fields(fields, D.detect_fields(fields))


def q_uncovered_fields(spark, sf):
    return _uncovered(spark, sf)[1]


def q_build_prompts(spark, sf):
    return V.build_schema_prompts(*_uncovered(spark, sf))


def _schema_answers(spark, sf):
    """Answers of a model about the columns of customer, one per market segment."""
    text = (
        "concat('Here it is: ```json\\n[{\"field\": \"c_name\", \"pii_type\": \"', "
        "if(length(c_mktsegment) % 2 = 0, 'Person Name', 'NAME'), '\", \"confidence\": ', "
        "length(c_mktsegment) / 10.0, ', \"reasoning\": \"r\"}, {\"field\": \"', c_mktsegment, "
        "'\", \"pii_type\": \"SSN\"}, {\"field\": \"c_acctbal\", \"pii_type\": \"nothing\"}, "
        "{\"field\": \"c_custkey\", \"pii_type\": \"ssn\"}]\\n``` done')"
    )
    return table(spark, sf, "customer").select("c_custkey", F.lit("customer").alias("topic"), F.expr(text).alias("response"))


def q_parse_schema_responses(spark, sf):
    known = FL.field_universe(topic_fields(spark, sf, "customer"))
    rows = V.parse_schema_response(_schema_answers(spark, sf), known)
    return rows.groupBy("topic", "field_path", "pii_type", "confidence", "needs_value_check").agg(
        F.count(F.lit(1)).alias("n")
    )


def q_parse_field_responses(spark, sf):
    text = (
        "concat('{\"pii\": ', if(o_orderkey % 3 = 0, 'false', 'true'), ', \"type\": \"', "
        "array('Credit Card', 'EMAIL', 'iban', 'nonsense')[cast(o_orderkey % 4 as int)], "
        "'\", \"confidence\": ', o_custkey / 1000.0, '}')"
    )
    rows = table(spark, sf, "orders").select(
        F.lit("orders").alias("topic"), F.lit(0).alias("partition"), F.col("o_orderkey").alias("offset"),
        F.lit("o_orderpriority").alias("field_path"), F.col("o_orderpriority").alias("value"), F.expr(text).alias("response"),
    )
    return V.parse_field_response(rows).select("offset", "pii_type", F.round("confidence", 6).alias("confidence"), "value")


def q_eligible_values(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.col("text").alias("value"))
    return V.eligible_values(docs).select("doc_id")


def q_verification_gate(spark, sf):
    analyses = table(spark, sf, "part").select(
        F.lit("part").alias("topic"), F.concat(F.lit("f"), "p_partkey").alias("field_path"),
        F.expr("if(p_partkey % 10 = 0, null, 'NAME')").alias("pii_type"),
        F.expr("cast(p_size * 2 as double) / 100").alias("confidence"),
        F.expr("p_size * 2 < 90").alias("needs_value_check"),
    )
    verdicts = table(spark, sf, "part").where("p_partkey % 3 <> 0").select(
        F.lit("part").alias("topic"), F.concat(F.lit("f"), "p_partkey").alias("field_path"),
        F.expr("p_partkey % 4 <> 1").alias("confirmed"),
        F.expr("cast(p_partkey % 11 as double) / 10").alias("confidence"),
    )
    return V.verification_gate(analyses, verdicts).select("field_path", "pii_type", "confidence", "value")


def q_spread_findings(spark, sf):
    fields = topic_fields(spark, sf, "customer")
    known = FL.field_universe(fields)
    answers = V.parse_schema_response(_schema_answers(spark, sf), known).groupBy("topic", "field_path", "pii_type").agg(
        F.max("confidence").alias("confidence")
    )
    findings = answers.withColumn("value", F.lit(V.SCHEMA_VALUE)).withColumn("pattern_matched", F.lit("schema"))
    return V.spread_schema_findings(findings, fields).select(
        "topic", "offset", "field_path", "pii_type", "confidence", "value", "hit_no"
    )


def _brand_detector(path: str, value: str):
    """A detector that exists only as Python code: brand names count as user names."""
    return [("USERNAME", 0.6, value)] if value.startswith("Brand#") else []


def q_detect_with_providers(spark, sf):
    V.register_provider("brands", lambda: V.RowProvider("brands", _brand_detector, ["USERNAME"]))
    fields = topic_fields(spark, sf, "part", "orders")
    return V.detect_with(fields, ["brands"], TYPE_NAMES).select(*_FOUND, "provider")


def _flaky_detector(path: str, value: str):
    """A detector that fails on some values."""
    if value.startswith("Brand#1"):
        raise ValueError("cannot read")
    return _brand_detector(path, value)


def q_run_errors(spark, sf):
    """Findings of a detector that fails on some values, and the errors of the run, by topic."""
    V.register_provider("flaky", lambda: V.RowProvider("flaky", _flaky_detector, ["USERNAME"]))
    found, errors = V.run_providers(topic_fields(spark, sf, "part", "orders"), ["flaky"], TYPE_NAMES)
    found = found.where("provider = 'flaky'").groupBy("topic", "provider").agg(
        F.lit(None).cast("string").alias("error"), F.count(F.lit(1)).alias("n")
    )
    return found.unionByName(errors.withColumnRenamed("failures", "n"))


def _brand_columns(paths, values):
    """The detector of ``_brand_detector`` over whole columns."""
    hit = values[values.str.startswith("Brand#")]
    return hit.rename("pattern_matched").rename_axis("row").reset_index().assign(pii_type="USERNAME", confidence=0.6)


def q_detect_with_columns(spark, sf):
    """The findings of ``detect_with_providers`` from a detector that takes columns."""
    V.register_provider("brand_columns", lambda: V.ColumnProvider("brands", _brand_columns, ["USERNAME"]))
    found, _ = V.run_providers(topic_fields(spark, sf, "part", "orders"), ["brand_columns"], TYPE_NAMES)
    return found.select(*_FOUND, "provider")


class _Clerk:
    """A schema-level provider with one rule: uncovered fields called status or segment hold names."""

    def is_available(self) -> bool:
        return True

    def supported_types(self) -> list[str]:
        return ["NAME"]

    def detect_in_schema(self, prompts: DataFrame) -> DataFrame:
        lines = prompts.select("topic", F.explode(F.split("fields_text", "\n")).alias("line"))
        paths = lines.select("topic", F.regexp_extract("line", "^- ([^:]+)", 1).alias("field_path"))
        return paths.where(F.col("field_path").rlike("(status|segment)$")).select(
            "topic", "field_path", F.lit("NAME").alias("pii_type"), F.lit(0.9).alias("confidence"),
            F.lit(V.SCHEMA_VALUE).alias("value"), F.lit("schema").alias("pattern_matched"),
        )


def q_schema_provider(spark, sf):
    """A schema-level provider from its prompts to findings of every message."""
    fields = topic_fields(spark, sf, "orders", "customer")
    found, _ = V.detect_in_schemas(fields, D.detect_fields(fields), [("clerk", _Clerk())], TYPE_NAMES)
    return found.select(*_FOUND, "hit_no")


# Tagging -----------------------------------------------------------------------------------------


def q_tag_annotations(spark, sf):
    return G.doc_annotation(_classified(spark, sf, _LOW, TYPE_NAMES)).select("topic", "field_path", "doc")


def q_subject_metadata(spark, sf):
    rows = G.subject_metadata(_classified(spark, sf, _LOW, TYPE_NAMES)).drop("tagged_at")
    return rows.withColumn("tags", F.array_join("tags", ","))


def q_tag_schema(spark, sf):
    """The orders schema with classifications in its metadata, shown next to the row count."""
    cls = C.classify_values(topic_fields(spark, sf, "orders"), all_totals(spark, sf, "orders"))
    tagged, count = G.tag_schema(table(spark, sf, "orders"), cls, "orders")
    notes = [(f.name, f.metadata.get("comment")) for f in tagged.schema.fields]
    docs = spark.createDataFrame(notes, "field string, comment string")
    return docs.withColumn("fields_tagged", F.lit(count)).withColumn("table_rows", tagged.agg(F.count(F.lit(1))).scalar())


def q_path_matches(spark, sf):
    cls = C.classify_values(topic_fields(spark, sf, "orders"), all_totals(spark, sf, "orders"))
    rows = G.path_matches(table(spark, sf, "orders").schema, cls, "orders")
    return rows.select("field_path", "detection_count")


def _avro_catalog(spark, sf):
    """Avro schemas of orders and events as a catalog; lineitem has none, customer a broken one."""
    rows = []
    for number, name in enumerate(("events", "orders")):
        fields = ",".join(f'{{"name":"{f.name}","type":"string"}}' for f in table(spark, sf, name).schema.fields)
        rows.append((f"{name}-value", 1, number + 1, "AVRO", f'{{"type":"record","name":"r","fields":[{fields}]}}'))
    rows.append(("words-value", 4, 3, "AVRO", '{"type":"string"}'))
    return spark.createDataFrame(
        [(*r, None) for r in rows],
        "subject string, version int, schema_id int, schema_type string, schema string, registered_at timestamp",
    )


def q_tag_catalog(spark, sf):
    log, _ = G.tag_catalog(_avro_catalog(spark, sf), _stored_classes(spark, sf))
    return log.withColumn("errors", F.array_join("errors", ";"))


def q_backup_schemas(spark, sf):
    """The schemas as they were before tagging."""
    path = scratch_path(spark, "backup")
    G.tag_catalog(_avro_catalog(spark, sf), _stored_classes(spark, sf), backup_path=path)
    return spark.read.parquet(path).select("subject", "version", "schema_id", "schema")


# Streaming ---------------------------------------------------------------------------------------


def _stream(spark, sf, msgs: DataFrame, per_trigger: int = 2) -> DataFrame:
    """The messages of a table as a stream over a folder of files."""
    shared_folder(spark)
    path = scratch_path(spark, "stream")
    msgs.repartition(6, "topic", "partition", "offset").write.parquet(path)
    return W.read_stream(spark, path, starting_position="earliest", per_trigger=per_trigger)


def _drain(spark, df: DataFrame, mode: str = "append", commits: str | None = None) -> DataFrame:
    """Run a stream over all there is and read its output; a batch of a stream in update mode has a folder of its own."""
    out = scratch_path(spark, "out")
    if mode == "append":
        W.write_stream(df, out, commits or scratch_path(spark, "commits")).awaitTermination()
    else:
        store = lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
        _drain_batches(spark, df, store, mode, commits)
    return spark.read.schema(df.schema).parquet(out)


def _drain_batches(spark, df: DataFrame, handle: Callable, mode: str = "append", commits: str | None = None) -> None:
    query = (
        df.writeStream.outputMode(mode).foreachBatch(handle)
        .option("checkpointLocation", commits or scratch_path(spark, "commits"))
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()


def q_stream_detect(spark, sf):
    stream = _stream(spark, sf, profile_messages(spark, sf))
    return _drain(spark, W.stream_detect(stream)).select(*_FOUND)


def q_stream_message_types(spark, sf):
    stream = _stream(spark, sf, profile_messages(spark, sf))
    rows = _drain(spark, W.stream_message_types(stream))
    return rows.select("topic", "offset", F.array_join("pii_types", ",").alias("pii_types"))


def q_stream_latest(spark, sf):
    """Clicks that came after the start of a stream; all other events lay in the folder before and stay unread."""
    msgs = event_messages(spark, sf)
    path = scratch_path(spark, "stream")
    msgs.where("topic <> 'click'").write.parquet(path)
    since = datetime.now(timezone.utc)
    msgs.where("topic = 'click'").write.mode("append").parquet(path)
    return _drain(spark, _picked(W.read_stream(spark, path, since=since)))


def q_dead_letters(spark, sf):
    stream = _stream(spark, sf, profile_messages(spark, sf))
    rows = _drain(spark, W.dead_letters(stream))
    return rows.select("topic", "partition", "offset", F.col("value").cast("string").alias("value"))


def q_stream_stats(spark, sf):
    stream = _stream(spark, sf, profile_messages(spark, sf))
    out = scratch_path(spark, "stats")
    _drain_batches(spark, W.stream_stats(stream), lambda b, _: b.write.mode("overwrite").parquet(out), "complete")
    return spark.read.parquet(out)


def q_next_offsets(spark, sf):
    return W.next_offsets(event_messages(spark, sf))


def q_resume_offsets(spark, sf):
    msgs = event_messages(spark, sf)
    seen = W.next_offsets(msgs.where("timestamp < timestamp'2024-01-10 00:00:00'"))
    return _picked(W.resume(msgs, seen))


def _outcomes(spark, sf, *more: Column):
    """Events of all types in one topic per user group; errors and purchases count as failures."""
    return table(spark, sf, "events").select(
        F.when(F.col("event_id") % 3 == 0, "hot").otherwise("cold").alias("topic"),
        F.lit(0).alias("partition"),
        F.col("event_id").alias("offset"),
        F.col("event_type").isin("error", "purchase", "view").alias("failed"),
        *more,
    )


def q_failure_streaks(spark, sf):
    return WS.failure_streaks(_outcomes(spark, sf), threshold=5, chunk=500)


def q_stream_streaks(spark, sf):
    """Streaks out of the state of a stream over files in any order."""
    outcomes = _outcomes(spark, sf, F.col("ts").alias("timestamp"))
    path, commits = scratch_path(spark, "events"), scratch_path(spark, "commits")
    outcomes.repartition(6, "topic", "partition", "offset").write.parquet(path)
    stream = spark.readStream.schema(outcomes.schema).parquet(path)
    _drain(spark, WS.stream_streaks(stream, threshold=5), "update", commits)
    return WS.streak_state(spark, commits, threshold=5)


def q_stream_classify(spark, sf):
    """Classifications out of the state of a stream."""
    commits = scratch_path(spark, "commits")
    stream = _stream(spark, sf, profile_messages(spark, sf))
    _drain(spark, WC.running_statistics(stream), "update", commits)
    return _joined(WC.classify_running(WC.running_state(spark, commits), C.Thresholds(0.5, 0.0, True)))


def q_stream_tag(spark, sf):
    """Tag the catalog while the stream runs; the catalog afterwards."""
    stream = _stream(spark, sf, profile_messages(spark, sf), per_trigger=3)
    fields = '{"name":"contact","type":{"type":"record","name":"c","fields":[{"name":"email","type":"string"}]}}'
    schema = f'{{"type":"record","name":"r","fields":[{fields}]}}'
    path = scratch_path(spark, "catalog")
    langs = table(spark, sf, "documents").select("lang").distinct().select(
        F.concat("lang", F.lit("-value")).alias("subject"), F.lit(1).alias("version"), F.lit(1).alias("schema_id"),
        F.lit("AVRO").alias("schema_type"), F.lit(schema).alias("schema"), F.current_timestamp().alias("registered_at"),
    )
    langs.write.parquet(path)
    tagger = WC.StreamTagger(path, C.Thresholds(0.5, 0.0, True))
    _drain_batches(spark, WC.running_statistics(stream), tagger, "update")
    return K.latest_schema(spark.read.parquet(path)).select("subject", "schema")


def q_monitor_windows(spark, sf):
    cls = WC.classify_windows(profile_messages(spark, sf), "5 minutes", C.Thresholds(0.5, 0.0, False))
    return _joined(cls)


def q_monitor_stream(spark, sf):
    """Windows that the watermark closed, classified from the stored statistics."""
    stream = _stream(spark, sf, profile_messages(spark, sf), per_trigger=6)
    types, totals = WC.monitor_stream(stream, "5 minutes", "1 minute")
    cls = WC.classify_closed(_drain(spark, types), _drain(spark, totals), C.Thresholds(0.5, 0.0, False))
    return _joined(cls)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name[2:]: fn for name, fn in list(globals().items()) if name.startswith("q_")
}
