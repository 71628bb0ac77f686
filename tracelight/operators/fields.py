"""From messages and tables to long-form field rows ``(topic, partition, offset, path, value)``."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelight.functions import records
from tracelight.functions.patterns import may_hold_pii, strip
from tracelight.operators.skew import skew_join

MESSAGE_KEY = ["topic", "partition", "offset"]
# Values that a field's inferred schema shows.
_FIRST_VALUES = 5
# Fields of one task that are counted before they are sent on, and groups that their counts are merged in first.
_MOST_KEYS = 100_000
_SALTS = 64


def stringify(value: Column) -> Column:
    """Text form of any value, without outer white space."""
    return F.btrim(value.cast("string"), F.lit(" \t\n\r\x0b\x0c"))


def split_wire_format(msgs: DataFrame) -> DataFrame:
    """Add ``framed``, ``schema_id`` and ``payload``: a framed value starts with a zero byte and a
    four-byte big-endian schema id."""
    framed = (F.length("value") >= 5) & (F.hex(F.substring("value", 1, 1)) == "00")
    return msgs.select(
        "*",
        F.coalesce(framed, F.lit(False)).alias("framed"),
        F.when(framed, F.conv(F.hex(F.substring("value", 2, 4)), 16, 10).cast("int")).alias("schema_id"),
        F.when(framed, F.expr("substring(value, 6, length(value))")).otherwise(F.col("value")).alias(
            "payload"
        ),
    )


def _parsed(msgs: DataFrame, record: str) -> DataFrame:
    # A generator of one row: filters on what comes out of it are not pushed below it, where they
    # would parse every message a second time.
    kept = [F.col(f"`{c}`") for c in msgs.columns if c not in ("json", "record", "levels")]
    return msgs.select(*kept, F.expr(f"inline_outer(array({record}))").alias("json", "record", "levels"))


def parse_json_lenient(msgs: DataFrame, column: str = "value") -> DataFrame:
    """Add ``json``, the record text of a message, with ``record``, the parsed text, and ``levels``,
    how deep it is nested. All three are null where there is no record; a message is parsed once."""
    rows = _parsed(msgs, records.record(f"cast({column} as binary)"))
    found = F.col("record").isNotNull()
    return rows.withColumns({"json": F.when(found, F.col("json")), "levels": F.when(found, F.col("levels"))})


def _with_record(decoded: DataFrame) -> DataFrame:
    """Messages with their parsed record, also if only the text is there."""
    if "record" in decoded.columns and "levels" in decoded.columns:
        return decoded
    return decoded.withColumns({"record": F.expr("try_parse_json(json)"), "levels": F.expr(records.nesting("json"))})


def decode_records(
    msgs: DataFrame, catalog: DataFrame | None = None, decoders=None, drop_empty: bool = True
) -> DataFrame:
    """Messages that hold a record, with its JSON text in ``json``, parsed once in ``record`` (nested
    ``levels`` deep), and ``schema_type``.

    ``decoders`` maps a schema type (``AVRO``, ``JSON`` …) to ``Column -> Column`` from the framed
    payload to JSON text: a permissive built-in (null for what it cannot read, like ``from_avro`` in that mode), or a
    Python codec in ``functions.decoders.row_decoder``. It gets null for rows of other types. A type without a
    decoder, an unframed value and a payload that the decoder fails on all take the lenient JSON path.
    The catalog is joined by ``skew_join``: one schema, or no schema, may hold most messages.
    Empty records are dropped; ``drop_empty=False`` keeps all messages, for callers that go on to
    the leaves, where a message without a record has none.
    """
    decoders = {k.upper(): v for k, v in (decoders or {}).items()}
    framed = split_wire_format(msgs)
    if catalog is None:
        typed = framed.withColumn("schema_type", F.lit(None).cast("string"))
    else:
        by_id = catalog.select("schema_id", F.upper("schema_type").alias("schema_type")).dropDuplicates(
            ["schema_id"]
        )
        typed = skew_join(framed, by_id, ["schema_id"], "left")
    decoded = F.lit(None).cast("string")
    for schema_type, decoder in decoders.items():
        mine = F.col("framed") & (F.coalesce("schema_type", F.lit("AVRO")) == schema_type)
        decoded = F.when(mine, decoder(F.when(mine, F.col("payload")))).otherwise(decoded)
    # A decoder may return a bare value; it becomes a record with the single field "value".
    as_record = F.when(decoded.rlike(r"^\s*\{"), decoded).otherwise(
        F.concat(F.lit('{"value":'), decoded, F.lit("}"))
    )
    if decoders:
        rows = _parsed(typed.withColumn("_decoded", as_record), records.record("value", "_decoded"))
        from_text = F.when(F.col("record").isNotNull(), F.col("json"))
        rows = rows.withColumn("json", F.coalesce("_decoded", from_text)).drop("_decoded")
    else:
        rows = parse_json_lenient(typed)
    rows = rows.drop("framed", "payload")
    if not drop_empty:
        return rows
    return rows.where(~F.col("json").rlike(r"^\s*(\{\s*\}|\[\s*\])\s*$"))


def _leaf_rows(msgs: DataFrame, entry_array: str, keep: Sequence[str]) -> DataFrame:
    # inline_outer keeps Catalyst from copying the whole fold into a pre-filter; rows without
    # leaves come out as nulls and are dropped right after.
    rows = _with_record(msgs).select(*MESSAGE_KEY, *keep, F.expr(f"inline_outer({entry_array})"))
    rows = rows.where(F.col("path").isNotNull())
    kind = F.schema_of_variant("node")
    value_type = (
        F.when(kind == "BOOLEAN", "boolean")
        .when(kind == "BIGINT", "integer")
        .when(kind.rlike(r"^DECIMAL\(\d+,0\)"), "integer")
        .when(kind.rlike("^(DECIMAL|DOUBLE|FLOAT)"), "number")
        .when(kind == "STRING", "string")
        .when(kind.startswith("ARRAY"), "array")
        .when(kind.startswith("OBJECT"), "object")
    )
    text = F.when(kind.rlike("^(ARRAY|OBJECT)"), F.to_json("node")).otherwise(F.col("node").cast("string"))
    return rows.select(
        *MESSAGE_KEY, F.col("path").alias("field_path"), value_type.alias("value_type"), text.alias("value"), *keep
    )


def flatten(decoded: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Field rows of records with a schema: ``a.b``, ``a[0]``, ``a[0].b``; a list directly inside a
    list stays one value, empty containers vanish. ``value_type`` is null for a JSON null. ``keep``
    names further message columns to carry along, here and in the functions below."""
    return _leaf_rows(decoded, records.entries(expand_nested_lists=False), keep)


def extract_fields(
    decoded: DataFrame,
    max_depth: int | None = None,
    include_arrays: bool = True,
    flatten_nested: bool = False,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Field rows of schemaless records: also nested lists and top-level arrays, down to
    ``max_depth``."""
    if flatten_nested:
        return flatten(decoded, keep)
    return _leaf_rows(
        decoded,
        records.entries(
            expand_nested_lists=True,
            include_arrays=include_arrays,
            max_depth=max_depth,
        ),
        keep,
    )


def fields_by_mode(decoded: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Field rows of messages flagged ``schemaless`` or not: each in its own mode, in one pass."""
    known, unknown = (records.entries(expand_nested_lists=e) for e in (False, True))
    return _leaf_rows(decoded, f"if(schemaless, {unknown}, {known})", keep)


def _cell(field: T.StructField) -> tuple[str, str, str]:
    """Name literal, value type and text of one column."""
    kind, name = field.dataType, field.name.replace("`", "``")
    text, label = f"cast(`{name}` as string)", "string"
    if isinstance(kind, T.StringType):
        text = strip(f"`{name}`")
    elif isinstance(kind, T.BooleanType):
        label = "boolean"
    elif isinstance(kind, T.IntegralType):
        label = "integer"
    elif isinstance(kind, T.FractionalType):
        label = "number"
    elif isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
        text, label = f"to_json(`{name}`)", "array" if isinstance(kind, T.ArrayType) else "object"
    path = field.name.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{path}'", f"'{label}'", text


def _searched_cell(field: T.StructField, path: str, text: str, cell: str) -> tuple[str, str]:
    """Text of one column, and whether it may hold a finding, if it is called ``cell``.

    The path is a constant here, so tests of it are settled in the plan. The text of a small integer
    is never made: without a hint in the path, eight digits are the least that a pattern finds.
    """
    kind, name = field.dataType, field.name.replace("`", "``")
    hinted = any(word in field.name.lower() for word in ("name", "address"))
    test = may_hold_pii(path, cell)
    if isinstance(kind, T.IntegralType):
        small = f"if(cast(`{name}` as bigint) between -9999999 and 9999999, null, {text})"
        return text if hinted else small, test
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        # Its text has a point or letters, so only a phone, card, address or date inside of it counts.
        return text, test if hinted else f"length({cell}) >= 10 and ({test})"
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        # nearly all of them match
        return text, "true"
    return text if isinstance(kind, (T.StringType, T.BooleanType, T.DecimalType)) else strip(text), test


def table_cells(
    df: DataFrame,
    topic: str,
    key: str,
    n_partitions: int = 3,
    columns: Sequence[str] | None = None,
    searched: bool = False,
) -> DataFrame:
    """Each table row as a message: the texts of its columns in ``cells``, their names and types as
    two constant arrays beside it. An array of plain strings is much cheaper to open than one of
    structs.

    The integer ``key`` gives the message partition (``key`` modulo ``n_partitions``) and offset.
    With ``searched``, for callers that look for findings of the patterns and nothing else, cells that
    cannot hold one are null.
    """
    names = columns or df.columns
    fields = [f for f in df.schema.fields if f.name in names]
    paths, kinds, texts = zip(*(_cell(f) for f in fields))
    key_columns = [F.pmod(F.col(key), F.lit(n_partitions)).cast("int").alias("partition"), F.col(key).cast("long").alias("offset")]
    if searched:
        # texts in a step of their own: each is made once, however often it is tested
        named = [_searched_cell(f, p, t, f"_{i}") for i, (f, p, t) in enumerate(zip(fields, paths, texts))]
        df = df.select(*key_columns, *[F.expr(text).alias(f"_{i}") for i, (text, _) in enumerate(named)])
        key_columns = ["partition", "offset"]
        texts = [f"_{i}" if test == "true" else f"if({test}, _{i}, null)" for i, (_, test) in enumerate(named)]
    return df.select(
        F.lit(topic).alias("topic"),
        *key_columns,
        F.expr(f"array({', '.join(texts)})").alias("cells"),
        F.expr(f"array({', '.join(paths)})").alias("paths"),
        F.expr(f"array({', '.join(kinds)})").alias("kinds"),
    )


def cell_rows(cells: DataFrame, searched: bool = False) -> DataFrame:
    """Field rows of one or several tables; with ``searched`` those of null cells are left out.

    Tables are put together as cells and opened afterwards: a generator stays above a union, so
    everything that follows is planned and compiled once and not once per table.
    """
    # Outer, although no row is without cells: otherwise a size() > 0 filter is pushed into the scan
    # and turns every column into text a second time.
    opened = cells.select(*MESSAGE_KEY, "paths", "kinds", F.posexplode_outer("cells").alias("pos", "value"))
    if searched:
        opened = opened.where(F.col("value").isNotNull())
    return opened.select(
        *MESSAGE_KEY,
        F.col("paths")[F.col("pos")].alias("field_path"),
        F.col("kinds")[F.col("pos")].alias("value_type"),
        "value",
    )


def table_fields(
    df: DataFrame, topic: str, key: str, n_partitions: int = 3, columns: Sequence[str] | None = None
) -> DataFrame:
    """Field rows straight from a table: one narrow pass, no JSON in between."""
    return cell_rows(table_cells(df, topic, key, n_partitions, columns))


# What ends a line or a sentence, with the blanks around it.
SENTENCE_END = r"[.!?]+[ \t\r\n]+|[ \t\r]*\n[ \t\r\n]*"


def text_fields(
    df: DataFrame, topic: Column | str, key: str, column: str, n_partitions: int = 3, boundary: str = SENTENCE_END
) -> DataFrame:
    """Field rows of a free text: its lines and sentences are the items of a list, ``text[0]``,
    ``text[1]`` …, so that a value with blanks (a name, a spaced phone or card number) is one value
    and not several words.

    The integer ``key`` gives the message partition and offset. Items without text are left out and
    keep their number; a null text has none. ``normalize_path`` makes all items one field.
    """
    # Outer, and filtered above the generator: a filter on the split text would split it twice.
    items = df.select(
        (F.lit(topic) if isinstance(topic, str) else topic).alias("topic"),
        F.pmod(F.col(key), F.lit(n_partitions)).cast("int").alias("partition"),
        F.col(key).cast("long").alias("offset"),
        F.posexplode_outer(F.split(F.col(f"`{column}`"), boundary)).alias("_pos", "_item"),
    ).where(F.col("_item") != "")
    return items.select(
        *MESSAGE_KEY,
        F.concat(F.lit(f"{column}["), F.col("_pos"), F.lit("]")).alias("field_path"),
        F.lit("string").alias("value_type"),
        stringify(F.col("_item")).alias("value"),
    )


def field_universe(fields: DataFrame) -> DataFrame:
    """All field paths of each topic."""
    return fields.select("topic", "field_path").distinct()


def _profiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: types, counts and the earliest values of each field, whatever the number of rows."""
    key = ["topic", "field_path"]
    order = ["partition", "offset", "value"]
    held: dict[tuple, list] = {}
    first = pa.list_(pa.struct([("partition", pa.int32()), ("offset", pa.int64()), ("value", pa.string())]))

    def flush() -> pa.RecordBatch:
        topics, paths = zip(*held)
        types, typed, rows, values = zip(*held.values())
        shown = [[dict(zip(order, v)) for v in own] for own in values]
        columns = [
            pa.array(topics, pa.string()), pa.array(paths, pa.string()), pa.array(map(sorted, types), pa.list_(pa.string())),
            pa.array(typed, pa.int64()), pa.array(rows, pa.int64()), pa.array(shown, first),
        ]
        return pa.RecordBatch.from_arrays(columns, names=[*key, "types", "sample_count", "total_count", "ranked"])

    for batch in batches:
        table = pa.Table.from_batches([batch])
        # counts of the batch in Arrow; Python only sees a row for each field of it and its first values
        counts = table.group_by(key).aggregate([("value_type", "distinct"), ("value_type", "count"), ([], "count_all")])
        names = [*key, "value_type_distinct", "value_type_count", "count_all"]
        for topic, path, types, typed, rows in zip(*(counts.column(c).to_pylist() for c in names)):
            now = held.setdefault((topic, path), [set(), 0, 0, []])
            now[0].update(t for t in types if t is not None)
            now[1] += typed
            now[2] += rows
        known = table.filter(pc.is_valid(table["value_type"]))
        known = known.sort_by([(c, "ascending") for c in (*key, *order)])
        # The first values stand at the head of their field: rows that differ from the one five before.
        new = pa.array([True] * min(_FIRST_VALUES, len(known)))
        if len(known) > _FIRST_VALUES:
            same = [
                pc.or_kleene(
                    pc.fill_null(pc.equal(known[k][_FIRST_VALUES:], known[k][:-_FIRST_VALUES]), False),
                    pc.and_(pc.is_null(known[k][_FIRST_VALUES:]), pc.is_null(known[k][:-_FIRST_VALUES])),
                )
                for k in key
            ]
            new = pa.concat_arrays([new, pc.invert(pc.and_(*same)).combine_chunks()])
        heads = known.filter(new)
        for topic, path, *place in zip(*(heads.column(c).to_pylist() for c in (*key, *order))):
            held[topic, path][3].append(tuple(place))
        for now in held.values():
            if len(now[3]) > _FIRST_VALUES:
                now[3] = sorted(now[3])[:_FIRST_VALUES]
        if len(held) > _MOST_KEYS:
            yield flush()
            held.clear()
    if held:
        yield flush()


def field_profiles(fields: DataFrame) -> DataFrame:
    """Types, counts and the five earliest values (``ranked``) of each field, in one pass.

    Rows are counted in their task, then in salted groups, then per field. What is sent on has one
    row for each field that a task has seen, so a field with billions of values costs no more than
    any other.
    """
    known = fields.select("topic", "field_path", "partition", "offset", "value_type", "value")
    parts = known.mapInArrow(
        _profiled,
        "topic string, field_path string, types array<string>, sample_count long, total_count long, "
        "ranked array<struct<partition:int,offset:long,value:string>>",
    )
    merged = [
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("types")))).alias("types"),
        F.sum("sample_count").alias("sample_count"),
        F.sum("total_count").alias("total_count"),
        F.slice(F.array_sort(F.flatten(F.collect_list("ranked"))), 1, _FIRST_VALUES).alias("ranked"),
    ]
    salted = parts.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(_SALTS)))
    return salted.groupBy("topic", "field_path", "_salt").agg(*merged).groupBy("topic", "field_path").agg(*merged)


def infer_schema(fields: DataFrame, min_samples: int = 10) -> DataFrame:
    """Type, nullability, counts and up to five values of each field path.

    The five values are those of the earliest messages (by partition and offset, then value).
    """
    kind = (
        F.when(F.size("types") == 0, "unknown")
        .when(F.array_contains("types", "string"), "string")
        .otherwise(F.col("types")[0])
    )
    return field_profiles(fields).select(
        "topic",
        "field_path",
        kind.alias("type"),
        (F.col("sample_count") < F.col("total_count")).alias("nullable"),
        "sample_count",
        "total_count",
        F.col("ranked.value").alias("sample_values"),
        (F.col("total_count") < min_samples).alias("few_samples"),
    )
