"""DuckDB SQL for the registered queries, with plans of its own.

Detection is spelled out as a long table of hits and a ranked self-join for the conflict rules,
where the engine uses arrays inside a row. Patterns, word lists and maps are the engine's constants, so
these queries check plans, not constants; the vectors in ``tests`` check those.
"""

from __future__ import annotations

from tracelight.functions.patterns import (
    CARD_WORDS, DATE_WORDS, ID_WORDS, NAME_INDICATORS, PATH_BOOSTS, PLATE_WORDS, TIME_WORDS, VALUE_PATTERNS,
)
from tracelight.operators.fields import SENTENCE_END
from tracelight.operators.providers import LIKELIHOOD, PROVIDER_ENTITIES
from tracelight.operators.spans import SPAN_PATTERNS
from tracelight.plans.catalogue import RULE_PATHS, RULE_TYPES, RULE_VALUES, TABLE_KEYS, TYPE_FIELDS, WORD_PATHS
from tracelight.schemas import CORE_TYPES, HIGH_RISK, PII_TYPES, PRIORITY, TYPE_NAMES

# Columns of the tables that are read as topics.
_COLUMNS = {
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
    "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment",
    "supplier": "s_suppkey s_name s_nationkey s_acctbal",
    "part": "p_partkey p_name p_brand p_type p_size p_retailprice",
    "nation": "n_nationkey n_name n_regionkey",
    "region": "r_regionkey r_name",
    "events": "event_id ts user_id event_type value props",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax "
                "l_returnflag l_linestatus l_shipdate",
}
_FIRST = ["o_orderkey", "c_custkey", "s_suppkey", "p_partkey", "n_nationkey", "r_regionkey", "event_id", "l_orderkey"]


def _list(words: list[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def _has(words: list[str]) -> str:
    return "(" + " or ".join(f"lower(path) like '%{w.replace('_', chr(92) + '_')}%' escape '{chr(92)}'" for w in words) + ")"


def _table_fields(names: list[str]) -> str:
    rows = []
    for name in names:
        key = TABLE_KEYS[name]
        for column in _COLUMNS[name].split():
            text = f"cast({column} as varchar)"
            rows.append(f"select '{name}' topic, ({key}) % 3 part, cast({key} as bigint) off, '{column}' path, {text} raw from {name}")
    return " union all ".join(rows)


_WORDS = (
    "select 'words' topic, doc_id % 3 part, doc_id * 2147483648 + pos - 1 off, "
    "list_extract(['" + "','".join(WORD_PATHS) + f"'], cast(doc_id % {len(WORD_PATHS)} + 1 as int)) path, w raw "
    "from (select doc_id, unnest(ws) w, generate_subscripts(ws, 1) pos from "
    r"(select doc_id, string_split_regex(text, '\s+') ws from documents))"
)
_DATES = " union all ".join(
    f"select 'orders' topic, o_orderkey % 3 part, o_orderkey off, '{n}' path, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') raw from orders"
    for n in ("o_orderdate", "event_time", "birth_id", "payment_date")
)


_PROFILES = "select doc_id, lang topic, doc_id % 3 part, doc_id off, doc_id % 10 = 7 plain, source from documents"


def _every(t: str, path: str) -> str:
    """All matches of a type in the texts, under a path that may name the number ``i`` of the match, from one on."""
    return (
        f"select lang topic, doc_id % 3 part, doc_id off, {path} path, raw from (select lang, doc_id, unnest(ms) raw, "
        f"generate_subscripts(ms, 1) i from (select lang, doc_id, regexp_extract_all(text, '{SPAN_PATTERNS[t]}') ms "
        "from documents where doc_id % 10 <> 7))"
    )


def _numbered(one: str, more: str) -> str:
    return f"case when i = 1 then '{one}' else '{more}[' || (i - 2) || ']' end"


_PROFILE_FIELDS = " union all ".join(
    [
        f"select lang topic, doc_id % 3 part, doc_id off, '{path}' path, {value} raw from documents where doc_id % 10 <> 7 and {value} <> ''"
        for path, value in [("doc_id", "cast(doc_id as varchar)"), ("source", "source")]
    ]
    + [
        _every("EMAIL", _numbered("contact.email", "contact.emails")),
        _every("PHONE_NUMBER", _numbered("contact.phone", "contact.phones")),
        _every("CREDIT_CARD", "'payment[' || (i - 1) || '].card_number'"),
        _every("IP_ADDRESS", _numbered("client_ip", "proxy_ips")),
    ]
)


def _sentences(path: str, table: str, topic: str, key: str) -> str:
    return (
        f"select topic, part, off, {path} path, raw from (select {topic} topic, {key} % 3 part, {key} off, unnest(ws) raw, "
        rf"generate_subscripts(ws, 1) i from (select *, string_split_regex(text, '{SENTENCE_END}') ws from {table})) where raw <> ''"
    )


_ITEM = "'text[' || (i - 1) || ']'"
_SENTENCES = _sentences(_ITEM, "documents", "lang", "doc_id")
_WHOLE_TEXTS = _sentences("'text'", "documents", "lang", "doc_id")

_DIGITS = (
    "select {key} n, {key} * 179424673 % 1000000000 x, lpad(cast({key} * 179424673 % 1000000000 as varchar), 9, '0') d from {table}"
)
_KEYED = (
    "(select n, d, translate(d, '0123456789', 'ABCDEFGHIJ') l, md5(d) h from ("
    + _DIGITS.format(key="c_custkey", table="customer") + "))"
)
_TYPED = " union all ".join(
    f"select 'types' topic, n % 3 part, n * 64 + {i} off, '{path}' path, {value} raw from {_KEYED}"
    for i, (path, value) in enumerate(TYPE_FIELDS)
)


def _pick(items: list[str], number: str) -> str:
    return f"list_extract([{', '.join(items)}], cast({number} % {len(items)} as int) + 1)"


_RULE_HITS = f"""hits as materialized (select n rid, 'rules' topic, n % 3 part, n off, path, v, i seq, t,
        cast((x + i * 7919) % 20 as double) / 20 conf, case t {' '.join(f"when '{t}' then {p}" for t, p in PRIORITY.items())} else 0 end prio, v m
    from (select *, {_pick([f"'{p}'" for p in RULE_PATHS], 'n')} path, {_pick(RULE_VALUES, f'(n // {len(RULE_PATHS)})')} v
        from ({_DIGITS.format(key='o_orderkey', table='orders')})),
        (values {', '.join(f"({i}, '{t}')" for i, t in enumerate(RULE_TYPES))}) said(i, t) where ((x >> i) & 1) = 1)"""


def _luhn(text: str) -> str:
    digits = f"reverse(regexp_replace({text}, '[- ]', '', 'g'))"
    d = f"cast(substring({digits}, i, 1) as int)"
    return (
        f"list_sum(list_transform(range(1, length({digits}) + 1), lambda i: "
        f"case when i % 2 = 1 then {d} when {d} > 4 then {d} * 2 - 9 else {d} * 2 end)) % 10 = 0"
    )


def _bad_ssn(text: str) -> str:
    d = f"replace({text}, '-', '')"
    return f"({d} like '000%' or {d} like '666%' or {d} = '123456789')"


def _confidence(t: str) -> str:
    if t == "CREDIT_CARD":
        return f"case when {_luhn('m')} then 0.95 else 0.5 end"
    if t == "NAME":
        many = r"len(string_split_regex(v, '\s+')) > 5"
        named = "lower(path) like '%name%'"
        return f"case when {named} and {many} then 0.7 when {named} then 0.9 when {many} then 0.3 else 0.5 end"
    boost, alternatives = PATH_BOOSTS[t]
    any_of = " or ".join("(" + " and ".join(_has([w]) for w in words) + ")" for words in alternatives)
    plain = f"case when {any_of} then {boost} else 0.7 end"
    return f"case when {_bad_ssn('m')} then 0.3 else {plain} end" if t == "SSN" else plain


def _hits(fields: str) -> str:
    """CTEs f (stripped field rows) and hits."""
    parts = []
    for seq, (t, pattern) in enumerate(VALUE_PATTERNS.items()):
        unless = {"PHONE_NUMBER": TIME_WORDS, "NAME": PLATE_WORDS}.get(t)
        extra = f" and not {_has(unless)}" if unless else ""
        parts.append(
            f"select rid, topic, part, off, path, v, {seq} seq, '{t}' t, cast({_confidence(t)} as double) conf, "
            f"{PRIORITY.get(t, 0)} prio, m from (select *, regexp_extract(v, '{pattern}', 0) m from f "
            f"where regexp_matches(v, '{pattern}'){extra})"
        )
    low = "replace(lower(path), '-', '_')"
    named = " or ".join(f"contains({low}, '{w}')" for w in NAME_INDICATORS)
    digits = "regexp_matches(v, '^[0-9]+$')"
    parts.append(
        f"select rid, topic, part, off, path, v, 15, 'NAME', 0.85, 65, 'field_name_hint:' || path from f where ({named}) "
        rf"and length(v) >= 2 and not {digits} and regexp_matches(v, '\p{{L}}') "
        f"and (not regexp_matches(v, '{VALUE_PATTERNS['NAME']}') or {_has(PLATE_WORDS)})"
    )
    parts.append(
        "select rid, topic, part, off, path, v, 16, 'ADDRESS', 0.85, 70, 'field_name_hint:' || path from f "
        f"where contains({low}, 'address') and length(v) >= 5 and not {digits}"
    )
    white = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"
    return (
        f"f as materialized (select row_number() over () rid, topic, part, off, path, trim(raw, {white}) v from ({fields}) where raw is not null), "
        f"hits as materialized ({' union all '.join(parts)})"
    )


def _kept(fields: str, enabled: list[str] = CORE_TYPES, field: str = "rid", hits: str | None = None) -> str:
    """CTEs up to det: the findings after the conflict rules and the type filter.

    ``hits`` stands for the findings where they are no pattern findings of ``fields``.

    One finding of each ``field`` of a message has the number 1.
    """
    epoch = r"regexp_matches(v, '^[0-9]{10,13}(\.[0-9]+)?$')"
    removed = (
        f"(t = 'PHONE_NUMBER' and (({_has(TIME_WORDS)} and {epoch}) or card)) or "
        f"(t = 'DATE_OF_BIRTH' and ({_has(TIME_WORDS)} or card or {_has(CARD_WORDS)} or "
        f"({_has(ID_WORDS)} and regexp_matches(v, '^[0-9]+$')))) or "
        f"(t in ('DRIVER_LICENSE', 'NAME', 'ADDRESS') and {_has(PLATE_WORDS)}) or "
        f"(t = 'CREDIT_CARD' and conf < 0.8 and {_has(DATE_WORDS)} and not {_has(CARD_WORDS)})"
    )
    key = "rid"  # one field of one message
    return (
        (hits or _hits(fields))
        + f""", ranked as (select *, row_number() over (partition by {key} order by prio desc, seq) place,
              bool_or(t = 'CREDIT_CARD') over (partition by {key}) card from hits),
        rivals as (select h.*, r.prio rival_prio, r.conf rival_conf from ranked h left join ranked r
              on h.rid = r.rid and r.place = case when h.place = 1 then 2 else 1 end),
        kept as (select rid, topic, part, off, path, v, seq, t, conf, m from rivals where not ({removed})
              and not coalesce(rival_prio > prio and rival_conf >= conf, false)),
        det as materialized (select *, row_number() over (partition by {field} order by seq) hit_no from kept
              where t in {_list(enabled) if enabled else "('')"})"""
    )


_OUT = "topic, cast(off as bigint) as \"offset\", path as field_path, t as pii_type, conf as confidence, v as value, m as pattern_matched"


def _ordinal(t: str = "t") -> str:
    return f"list_position({TYPE_NAMES!r}, {t})"


_TAGS = "case t " + " ".join(f"when '{n}' then {tags[1:]!r}" for n, _, _, tags in PII_TYPES) + " end"


def _classes(fields: str, enabled: list[str], confidence: float, rate: float, multiple: bool, totals: str | None = None, field: str = "rid") -> str:
    """CTEs up to cls (lists still as lists)."""
    totals = totals or (
        "select topic, count(*) total from f where topic = 'words' or path in " + _list(_FIRST) + " group by topic"
    )
    return (
        _kept(fields, enabled, field)
        + f""", totals as ({totals}),
        stats as (select topic, path, t, count(*) n, avg(conf) mean, sum(case when hit_no = 1 then 1 else 0 end) msgs
              from det group by all),
        per_field as (select topic, path, sum(msgs) detection_count,
              avg(mean) filter (round(mean, 9) >= {confidence}) confidence,
              list(t order by {_ordinal()}) filter (round(mean, 9) >= {confidence}) types,
              list_distinct(flatten(list({_TAGS} order by {_ordinal()}) filter (round(mean, 9) >= {confidence}))) tagset
              from stats group by topic, path),
        tagged as (select topic, path, list(tag order by o, i) tags from (
              select topic, path, tag, min({_ordinal()}) o, min(i) i from (
                select topic, path, t, unnest(tg) tag, generate_subscripts(tg, 1) i from (
                  select topic, path, t, {_TAGS} tg from stats where round(mean, 9) >= {confidence})) group by all)
              group by topic, path),
        samples as (select topic, path, list(v order by v) vs from (
              select topic, path, v, row_number() over (partition by topic, path order by v) rn
              from (select distinct topic, path, v from det where v <> '')) where rn <= 10 group by topic, path),
        cls as (select topic, path field_path, types, list_concat(['PII'], tags) tags, confidence,
              cast(detection_count as bigint) detection_count, total total_samples,
              least(1.0, detection_count / total) detection_rate, vs
              from per_field join totals using (topic) join tagged using (topic, path) join samples using (topic, path)
              where len(types) > 0 and least(1.0, detection_count / total) >= {rate}
              {'and detection_count >= 2' if multiple else ''})"""
    )


_SHOW = (
    "topic, field_path, array_to_string(types, '|') pii_types, array_to_string(tags, '|') tags, "
    "round(confidence, 6) confidence, detection_count, total_samples, round(detection_rate, 6) detection_rate, "
    "array_to_string(vs, '|') sample_values"
)
_ALL = _WORDS + " union all " + _table_fields(list(TABLE_KEYS))
_LOW = dict(enabled=TYPE_NAMES, confidence=0.6, rate=0.0, multiple=True)
_STD = dict(enabled=CORE_TYPES, confidence=0.7, rate=0.3, multiple=True)
_PROFILE_TOTALS = "select lang topic, count(*) total from documents group by lang"
_PROFILE_CLS = dict(enabled=CORE_TYPES, confidence=0.5, rate=0.0, multiple=True, totals=_PROFILE_TOTALS)

_TEXT_CLS = dict(
    enabled=TYPE_NAMES, confidence=0.5, rate=0.0, multiple=True, totals=_PROFILE_TOTALS, field="topic, part, off, path"
)

_LIST_FIELDS = " union all ".join(
    f"select lang topic, doc_id % 3 part, doc_id off, '{path}' path, unnest({values}) raw from documents"
    for path, values in [("doc_id", "[cast(doc_id as varchar)]")] + [
        (path, f"regexp_extract_all(text, '{SPAN_PATTERNS[t]}')")
        for path, t in [("contacts.email", "EMAIL"), ("client_ip", "IP_ADDRESS"), ("cards", "CREDIT_CARD")]
    ]
)
_LIST_CLS = dict(
    enabled=CORE_TYPES, confidence=0.5, rate=0.0, multiple=False, totals=_PROFILE_TOTALS, field="topic, part, off, path"
)

_EVENTS = "select event_type topic, event_id % 3 part, event_id off, ts from events"
_PART_CATALOG = (
    "select p_brand || '-value' subject, cast(p_partkey as int) \"version\", cast(p_partkey + 1000 as int) schema_id, p_name \"schema\" from part"
)
_NAMED = (
    "select case when doc_id % 7 = 0 then '_' when doc_id % 11 = 0 then '__transaction_state-' else '' end || source topic from documents"
)


def _first_of_tail(n: int, keep: int) -> str:
    return (
        f"select topic, cast(part as int) \"partition\", off as \"offset\" from (select *, row_number() over (partition by topic, part order by off) rn "
        f"from (select *, row_number() over (partition by topic, part order by off desc) b from ({_EVENTS})) where b <= {n}) where rn <= {keep}"
    )


def _bernoulli(most: int | None) -> str:
    digits = "md5(topic || ':' || part || ':' || off || ':42')[:8]"
    limit = f"qualify row_number() over (partition by topic, part order by off) <= {most}" if most else ""
    return (
        f"""with numbered as (select *, row_number() over (partition by topic, part order by off) rn,
            cast('0x' || {digits} as bigint) < cast(floor(0.1 * 4294967296) as bigint) lucky from ({_EVENTS}))
        select topic, cast(part as int) "partition", off as "offset" from numbered where rn <= 10 or lucky {limit}"""
    )


def _stride(tail: int | None, share: float, low: int, high: int | None = None) -> str:
    limit = f"where b <= {tail}" if tail else ""
    most = f" and place // step < {high}" if high else ""
    return (
        f"""with tail as (select * from (select *, row_number() over (partition by topic, part order by off desc) b from ({_EVENTS})) {limit}),
        sized as (select *, row_number() over (partition by topic, part order by off) - 1 place,
            count(*) over (partition by topic, part) n from tail),
        stepped as (select *, greatest(1, n // greatest({low}, least(cast(floor(n * {share}) as bigint), {high or 'n'}))) step from sized)
        select topic, cast(part as int) "partition", off as "offset" from stepped where place % step = 0{most}"""
    )


# A word boundary of DuckDB only knows ASCII letters, that of Spark all letters. So other letters are turned
# into, or set between, underscores, which are word characters that no pattern but EMAIL accepts.
_LETTER = "[À-ÖØ-öø-ɏ]"


def _spans(table: str, column: str, keys: str) -> str:
    parts = []
    for t, p in SPAN_PATTERNS.items():
        text = column if t == "EMAIL" else f"regexp_replace({column}, '{_LETTER}', '_', 'g')"
        score = {
            "CREDIT_CARD": f"case when {_luhn('m')} then 0.95 else 0.5 end",
            "SSN": f"case when {_bad_ssn('m')} then 0.3 else 0.7 end",
        }.get(t, "0.7")
        parts.append(
            f"""select {keys}, '{t}' pii_type, cast(i - 1 as int) span_no, cast(gap + before as int) "start",
            cast(gap + before + length(m) as int) "end", m as value, cast({score} as double) confidence from (
              select {keys}, unnest(ms) m, generate_subscripts(ms, 1) i,
                unnest(list_transform(range(1, len(ms) + 1), lambda k: list_sum(list_transform(pieces[1:k], lambda x: length(x))))) gap,
                unnest(list_transform(range(1, len(ms) + 1), lambda k: coalesce(list_sum(list_transform(ms[1:k - 1], lambda x: length(x))), 0))) before
              from (select {keys}, regexp_extract_all({text}, '{p}') ms, string_split_regex({text}, '{p}') pieces from {table}
                    where regexp_matches({text}, '{p}')))"""
        )
    return " union all ".join(parts)


def _resolved(table: str, column: str, key: str) -> str:
    """CTEs up to survivors: spans without those that an overlapping one of another type beats."""
    prio = "case t " + " ".join(f"when '{t}' then {p}" for t, p in PRIORITY.items()) + " else 0 end"
    order = "case t " + " ".join(f"when '{t}' then {i}" for i, t in enumerate(VALUE_PATTERNS)) + " end"
    return f"""all_spans as materialized (select *, {prio} prio, {order} seq from (
            select {key} k, pii_type t, "start" b, "end" e, "value" v, confidence c from ({_spans(table, column, key)}))),
        rivals as (select s.k, s.t, s.b, s.e, bool_or(r.t = 'CREDIT_CARD') card, arg_max(struct_pack(p := r.prio, c := r.c), (r.prio, -r.seq)) top
            from all_spans s join all_spans r on s.k = r.k and s.t <> r.t and s.b < r.e and r.b < s.e group by all),
        survivors as (select s.* from all_spans s left join rivals r on s.k = r.k and s.t = r.t and s.b = r.b
            where not coalesce(r.card and s.t in ('PHONE_NUMBER', 'DATE_OF_BIRTH'), false) and not coalesce(r.top.p > s.prio and r.top.c >= s.c, false))"""


def _redacted(text: str) -> str:
    for t, p in SPAN_PATTERNS.items():
        text = f"regexp_replace({text}, '{p}', '[{t}]', 'g')"
        if t == "EMAIL":
            text = f"regexp_replace({text}, '({_LETTER})', '_\\1_', 'g')"
    return f"regexp_replace({text}, '_({_LETTER})_', '\\1', 'g')"


def _masked_text() -> str:
    sql = "select doc_id, text from documents"
    for t in ("EMAIL", "CREDIT_CARD", "IP_ADDRESS"):
        p = SPAN_PATTERNS[t]
        sql = (
            "select doc_id, array_to_string(list_transform(range(1, len(pieces) + 1), lambda k: "
            "pieces[k] || coalesce(repeat('*', length(ms[k])), '')), '') as text from "
            f"(select doc_id, string_split_regex(text, '{p}') pieces, regexp_extract_all(text, '{p}') ms from ({sql}))"
        )
    return sql


def _mask(value: str, keep: int) -> str:
    return (
        f"case when length({value}) <= {keep} then repeat('*', length({value})) "
        f"else repeat('*', length({value}) - {keep}) || {f'right({value}, {keep})' if keep else repr('')} end"
    )


def _values(rows: list[tuple]) -> str:
    return "(values " + ", ".join("(" + ", ".join(repr(x) for x in r) + ")" for r in rows) + ")"


_ENTITIES = _values([(p, e, t) for p, m in PROVIDER_ENTITIES.items() for e, t in m.items()])
# A schema id with the byte of an opening brace spoils the search for the start of the JSON text.
_BRACED = "(kind = 0 and (user_id % 256 = 123 or user_id // 256 % 256 = 123 or user_id // 65536 % 256 = 123))"
_BODY = (
    "select event_type topic, event_id off, user_id, props, event_id % 5 kind from events"
)
_UNCOVERED = "select distinct topic, path field_path from f where (topic, path) not in (select (topic, path) from det)"
_ORDERS_CUSTOMER = _table_fields(["orders", "customer"])
_ANSWER = """case when item = 1 then 'c_name' else 'c_custkey' end field_path,
    case when item = 1 then 'NAME' else 'SSN' end pii_type,
    cast(case when item = 1 then least(1.0, length(c_mktsegment) / 10.0) else 0.8 end as double) confidence"""
_ANSWERS = f"select c_custkey, {_ANSWER} from customer, (values (1), (2)) v(item)"
_TYPE_LIST = "string_agg(t, ',' order by t)"
_SUMMARY_CTES = (
    _classes(_ALL, **_STD)
    + """, names as (select topic from totals union select source from documents),
    summary as (select topic, coalesce(total, 0) samples, coalesce(n, 0) fields_classified, coalesce(n, 0) pii_fields_found
        from names left join totals using (topic) left join (select topic, count(*) n from cls group by topic) using (topic))"""
)
_OUTCOMES = (
    "select case when event_id % 3 = 0 then 'hot' else 'cold' end topic, 0 part, event_id off, "
    "event_type in ('error', 'purchase', 'view') failed from events"
)
_ISLANDS = f"""ev as ({_OUTCOMES}),
    marked as (select *, sum(case when failed then 0 else 1 end) over (partition by topic order by off) run from ev),
    runs as (select topic, run, min(off) start_offset, max(off) end_offset, count(*) failures from marked where failed group by topic, run)"""
_WINDOWED = _PROFILE_FIELDS.replace("select lang topic", "select lang || '|' || cast(doc_id // 300 as varchar) topic")
_WINDOW_CLS = dict(
    enabled=CORE_TYPES, confidence=0.5, rate=0.0, multiple=False,
    totals="select lang || '|' || cast(doc_id // 300 as varchar) topic, count(*) total from documents group by 1",
)
_WINDOW_SHOW = _SHOW.replace(
    "topic, field_path",
    "split_part(topic, '|', 1) topic, timestamp '2024-01-01 00:00:00' + to_minutes(5 * cast(split_part(topic, '|', 2) as int)) "
    "window_start, field_path", 1,
)
_DOC_OF = "select cast(off // 2147483648 as bigint) doc_id, * from det"
_DOC_SCHEMA = (
    '{"type":"record","name":"r","fields":[{"name":"contact","type":{"type":"record","name":"c","fields":'
    '[{"name":"email","type":"string"}]}}]}'
)
_DOC_TAGGED = (
    '{"type": "record", "name": "r", "fields": [{"name": "contact", "type": {"type": "record", "name": "c", "fields": '
    '[{"name": "email", "type": "string", "doc": "PII: EMAIL (confidence: 0.95)"}]}}]}'
)


def _avro_schema(name: str) -> str:
    fields = ",".join(f'{{"name":"{c}","type":"string"}}' for c in _COLUMNS[name].split())
    return f'{{"type":"record","name":"r","fields":[{fields}]}}'


def _avro(name: str) -> str:
    return ", ".join(_COLUMNS[name].split())


ORACLE: dict[str, str] = {
    "topic_profile": " union all ".join(
        f"select '{t}' topic, cast({k} % 3 as int) \"partition\", 0::bigint low, count(*) high, count(*) message_count from {t} group by {k} % 3"
        for t, k in [("orders", "o_orderkey"), ("customer", "c_custkey"), ("events", "event_id")]
    ),
    "to_messages": """select 'orders' topic, cast(o_orderkey % 4 as int) "partition",
        row_number() over (partition by o_orderkey % 4 order by o_orderkey) - 1 as "offset", cast(o_orderkey as varchar) as key,
        '{"o_orderkey":' || o_orderkey || ',"o_custkey":' || o_custkey || ',"o_orderstatus":"' || o_orderstatus || '","o_totalprice":' ||
        o_totalprice || ',"o_orderdate":"' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000') || '","o_orderpriority":"' || o_orderpriority || '"}'
        as value from orders""",
    "sparse_keys": """select cast(wide % 2 as int) "partition", row_number() over (partition by wide % 2 order by wide) - 1 as "offset",
        '{"o_orderkey":' || o_orderkey || ',"wide":' || wide || '}' as value
        from (select o_orderkey, o_orderkey * o_orderkey * 1000003 wide from orders)""",
    "read_messages": """select event_type topic, cast(event_id % 3 as int) "partition", event_id as "offset", props as value
        from events where event_type in ('click', 'error')""",
    "list_topics": "select distinct event_type topic from events where event_type like 'c%' or event_type like 'err%'",
    "resolve_topics": f"""select distinct topic from ({_NAMED}) where topic not like '\\_%' escape '\\'
        and not regexp_matches(topic, 'c1[0-4]$') and not contains(topic, '7(')""",
    "default_topics": f"select distinct topic from ({_NAMED}) where not starts_with(topic, '_')",
    "exclude_listed": f"select distinct topic from ({_NAMED}) where topic not in (select source from documents where n_chars > 15000)",
    "empty_topics": """select topic, topic not in (select event_type from events) is_empty from
        (select event_type topic from events union select p_brand from part)""",
    "flag_schemaless": """select topic, topic not in (select p_brand from part) schemaless from
        (select p_brand topic from part union select c_mktsegment from customer)""",
    "latest_schema": f"select * from ({_PART_CATALOG}) qualify row_number() over (partition by subject order by \"version\" desc) = 1",
    "schema_lookup": f"""select 'version' how, * from ({_PART_CATALOG}) where subject = 'Brand#17-value' and "version" = 1
        union all select 'id', * from ({_PART_CATALOG}) where schema_id = 1005""",
    "schema_exists": """select subject, subject in (select p_brand || '-value' from part) as "exists" from
        (select c_mktsegment || '-value' subject from customer union select p_brand || '-value' from part)""",
    "list_subjects": "select distinct p_brand || '-value' subject from part",
    "register_schemas": """with names as (select c_mktsegment n from customer union select p_brand from part)
        select n || '-value' subject, cast(coalesce(top, 0) + 1 as int) "version",
        cast((select max(p_partkey) + 1000 from part) + row_number() over (order by n || '-value') as int) schema_id,
        'AVRO' schema_type, n as "schema" from names left join (select p_brand, max(p_partkey) top from part group by 1) on n = p_brand""",
    "wire_format": f"""select topic, off as "offset", kind = 0 framed, cast(case when kind = 0 then user_id end as int) schema_id,
        cast(length(props) + case kind when 2 then 3 when 3 then 5 else 0 end as int) payload_bytes from ({_BODY}) where kind <> 4
        union all select topic, off, false, null, 2 from ({_BODY}) where kind = 4""",
    "parse_json_lenient": f"""select topic, off as "offset", case when kind = 3 or {_BRACED} then null when kind = 4 then '{{}}' else props end json from ({_BODY})""",
    "decode_records": f"""select topic, off as "offset", case when kind = 0 and p_type = 'PROMO'
        then '{{"value":' || regexp_extract(props, '[0-9]+', 0) || '}}' else props end json
        from ({_BODY}) left join part on p_partkey = user_id where kind < 3 and not (coalesce(p_type, '') <> 'PROMO' and {_BRACED})""",
    "flatten_json_fields": """select event_type topic, event_id as "offset", path field_path, kind value_type, v as value from events,
        lateral (values ('u.id', 'integer', cast(user_id as varchar)), ('u.t[0]', 'string', event_type),
        ('u.t[1]', 'array', '[' || event_id || ',7]'), ('p.k', 'integer', regexp_extract(props, '[0-9]+', 0)), ('n', null, null)) x(path, kind, v)""",
    "extract_json_fields": """select event_type topic, event_id as "offset", path field_path, kind value_type, v as value from events,
        lateral (values ('[0].id', 'integer', cast(event_id as varchar)), ('[1][0]', 'string', event_type),
        ('[1][1][0]', 'integer', cast(user_id as varchar)), ('[1][1][1].k.k', 'integer', regexp_extract(props, '[0-9]+', 0))) x(path, kind, v)""",
    "extract_to_depth": """select event_type topic, event_id as "offset", path field_path, kind value_type, v as value from events,
        lateral (values ('[0].id', 'integer', cast(event_id as varchar)), ('[1][0]', 'string', event_type),
        ('[1][1][0]', 'integer', cast(user_id as varchar))) x(path, kind, v)""",
    "field_universe": """select distinct event_type topic, path field_path from events,
        lateral (values ('u.id'), ('u.t[0]'), ('u.t[1]'), ('p.k'), ('n')) x(path)""",
    "infer_schema": """with f as (select event_type topic, event_id, path, kind, v from events,
        lateral (values ('u.id', 'integer', cast(user_id as varchar)), ('u.t[0]', 'string', event_type),
        ('u.t[1][0]', 'integer', cast(event_id as varchar)), ('u.t[1][1]', 'integer', '7'),
        ('p.k', 'integer', regexp_extract(props, '[0-9]+', 0)), ('n', null, null)) x(path, kind, v)),
        ranked as (select *, row_number() over (partition by topic, path order by event_id % 3, event_id) rn from f)
        select topic, path field_path, coalesce(max(kind), 'unknown') as "type", count(kind) < count(*) nullable,
        count(kind) sample_count, count(*) total_count,
        coalesce(string_agg(v, '|' order by rn) filter (rn <= 5 and kind is not null), '') sample_values, count(*) < 10 few_samples
        from ranked group by topic, path""",
    "sanitize_names": r"select page_id, trim(regexp_replace(url, '[^\p{L}\p{N}_.-]', '_', 'g'), '_') as name from pages",
    "normalize_paths": """select path, cast(sum(n) as bigint) n from (select x.path, count(*) n from events,
        lateral (values ('.id'), (''), (''), ('.k.k')) x(path) group by x.path) group by path""",
    "stringify": "select p_partkey, p_name as name, cast(p_size as varchar) as size from part",
    "sample_tail": f"""select topic, cast(part as int) "partition", off as "offset" from ({_EVENTS})
        qualify row_number() over (partition by topic, part order by off desc) <= 50""",
    "sample_percentage": _stride(None, 0.05, 10),
    "sample_percentage_capped": _stride(200, 0.05, 10, 1000),
    "sample_percentage_uncapped": _stride(2000, 0.10, 10, 100),
    "sample_nth": f"""select topic, cast(part as int) "partition", off as "offset" from ({_EVENTS})
        qualify row_number() over (partition by topic, part order by off) % 20 = 0""",
    "sample_nth_capped": f"""with tail as (select * from ({_EVENTS}) qualify row_number() over (partition by topic, part order by off desc) <= 200)
        select topic, cast(part as int) "partition", off as "offset" from (select *, row_number() over (partition by topic, part order by off) place from tail)
        where place % 20 = 0 and place // 20 <= 1000""",
    "sample_count": f"""select topic, cast(part as int) "partition", off as "offset" from ({_EVENTS})
        qualify row_number() over (partition by topic, part order by off) <= 500""",
    "sample_count_capped": _first_of_tail(200, 30),
    "sample_all_capped": _first_of_tail(200, 100),
    "sample_time_window": f"""select topic, cast(part as int) "partition", off as "offset" from ({_EVENTS})
        where ts >= timestamp '2024-01-15 12:00:00' - interval 36 hour""",
    "sample_first_partitions": f"""select topic, cast(part as int) "partition", off as "offset" from ({_EVENTS}) where part < 2""",
    "sample_bernoulli": _bernoulli(None),
    "sample_bernoulli_capped": _bernoulli(40),
    "target_sample_counts": f"""with t as (select topic, count(distinct part) partitions, count(*) total from ({_EVENTS}) group by topic)
        select topic, partitions, total, cast(target as bigint) target, strategy from (
        select *, total target, 'all' strategy from t
        union all select *, greatest(partitions * 10, least(cast(floor(total * 0.05) as bigint), partitions * 40)), 'percentage' from t
        union all select *, partitions * 100, 'count' from t union all select *, partitions * 100, 'time_based' from t)""",
    "detect_values": f"with {_hits(_WORDS)} select {_OUT} from hits",
    "detect_tables": f"with {_hits(_table_fields(list(TABLE_KEYS)))} select {_OUT} from hits",
    "resolve_conflicts": f"with {_kept(_WORDS, TYPE_NAMES)} select {_OUT} from det",
    "detect_sentences": f"with {_hits(_SENTENCES)} select {_OUT} from hits",
    "resolve_sentences": f"with {_kept(_SENTENCES, TYPE_NAMES)} select {_OUT} from det",
    "classify_texts": f"with {_classes(_WHOLE_TEXTS, **_TEXT_CLS)} select {_SHOW} from cls",
    "detect_all_types": f"with {_hits(_TYPED)} select {_OUT} from hits",
    "resolve_all_types": f"with {_kept(_TYPED, TYPE_NAMES)} select {_OUT} from det",
    "resolve_all_rules": f"with {_kept('', TYPE_NAMES, hits=_RULE_HITS)} select {_OUT} from det",
    "classify_type_fields": f"""with {_classes(_TYPED, **_LOW, totals="select 'types' topic, count(*) total from f")} select {_SHOW} from cls""",
    "resolve_grouped": f"with {_kept(_WORDS, TYPE_NAMES)} select {_OUT} from det",
    "detect_core_types": f"with {_kept(_WORDS)} select {_OUT} from det",
    "detect_two_types": f"with {_hits(_WORDS)} select {_OUT} from hits where t in ('EMAIL', 'IP_ADDRESS')",
    "detect_dates": f"with {_kept(_DATES, TYPE_NAMES)} select {_OUT} from det",
    "dedupe_findings": f"""with {_hits(_WORDS)} select topic, cast(off as bigint) as "offset", path field_path, t pii_type,
        case when off % 2 = 0 then 0.99 else conf end confidence, v as value, m pattern_matched,
        case when off % 2 = 0 then 'second' else 'pattern' end provider from hits""",
    "detect_messages": f"with {_kept(_PROFILE_FIELDS)} select {_OUT} from det",
    "message_types": f"""with {_kept(_PROFILE_FIELDS)} select p.topic, p.off as "offset", coalesce(ts, '') pii_types from ({_PROFILES}) p
        left join (select off, string_agg(distinct t, ',' order by t) ts from det group by off) d on p.off = d.off where not plain""",
    "classify_fields": f"with {_classes(_ALL, **_STD)} select {_SHOW} from cls",
    "classify_findings": f"with {_classes(_ALL, **_STD)} select {_SHOW} from cls",
    "classify_all_types": f"with {_classes(_ALL, **_LOW)} select {_SHOW} from cls",
    "type_stats": f"""with {_kept(_WORDS, TYPE_NAMES)} select topic, path field_path, t pii_type, count(*) type_count,
        round(avg(conf), 6) type_confidence from det group by all""",
    "detection_rates": f"""with {_kept(_WORDS, TYPE_NAMES)}, n as (select count(*) total_samples from f)
        select topic, path field_path, count(distinct off) detection_count, total_samples,
        round(count(distinct off) / total_samples, 9) detection_rate from det, n group by topic, path, total_samples""",
    "sample_values": f"""with {_kept(_WORDS, TYPE_NAMES)} select topic, path field_path, string_agg(v, '|' order by v) sample_values from (
        select *, row_number() over (partition by topic, path order by v) rn from (select distinct topic, path, v from det))
        where rn <= 10 group by topic, path""",
    "topic_summary": f"""with {_SUMMARY_CTES} select *, false schemaless, samples = 0 as "empty" from summary""",
    "triage_topics": f"""with {_SUMMARY_CTES} select topic, case when pii_fields_found > 0 then 'pii' when samples > 0 then 'data_no_pii'
        else 'empty' end triage, samples, pii_fields_found from summary""",
    "run_summary": f"""with {_SUMMARY_CTES}, bad as (select source from documents where n_chars > 15000)
        select count(*) topics_analyzed, cast(sum(fields_classified) as bigint) total_fields_classified,
        cast(sum(pii_fields_found) as bigint) total_pii_fields, count(*) filter (samples = 0) empty_topics,
        (select count(*) from bad) errors from summary where topic not in (select source from bad)""",
    "tags_summary": f"""with {_classes(_ALL, **_LOW)} select 'tag' kind, label, count(*) fields from (select unnest(tags) label from cls) group by label
        union all select 'type', label, count(*) from (select unnest(types) label from cls) group by label
        union all select 'total', 'fields', count(*) from cls""",
    "risk_rollup": f"""with {_classes(_ALL, **_LOW)}, rows as (select topic, unnest(types) t from cls),
        risk(t, risk_level) as {_values([(n, r) for n, _, r, _ in PII_TYPES])}
        select topic, risk_level, cast(grouping(topic, risk_level) as bigint) as "level", count(*) fields
        from rows join risk using (t) group by rollup (topic, risk_level)""",
    "detection_summary": f"""with {_kept(_WORDS, TYPE_NAMES)}, d as ({_DOC_OF})
        select documents.doc_id, n is not null pii_detected, coalesce(ts, '') pii_types, coalesce(c, 0.0) max_confidence,
        coalesce(risky, false) high_risk, coalesce(n, 0) detection_count from documents left join (
        select doc_id, string_agg(distinct t, ',' order by t) ts, max(conf) c, bool_or(t in {_list(HIGH_RISK)}) risky, count(*) n
        from d group by doc_id) x on documents.doc_id = x.doc_id""",
    "high_risk_docs": f"""with {_kept(_WORDS, TYPE_NAMES)}, d as ({_DOC_OF})
        select doc_id, bool_or(t in {_list(HIGH_RISK)}) high_risk from d group by doc_id""",
    "classification_metrics": """select count(*) runs, cast(sum(t) as bigint) topics_analyzed, cast(sum(p) as bigint) pii_fields_found,
        max(m) last_run from (select cast(ts as date), count(distinct event_type) t, count(*) filter (event_type = 'error') p,
        max(ts) m from events group by 1)""",
    "analyze_messages": f"with {_classes(_PROFILE_FIELDS, **_PROFILE_CLS)} select {_SHOW} from cls",
    "report_rows": f"""with {_classes(_ALL, **_LOW)}, short as (select *, list_transform(vs[1:5], lambda v:
            case when length(v) > 50 then left({_mask('v', 4)}, 47) || '...' else {_mask('v', 4)} end) shown from cls)
        select topic, field_path, array_to_string(types, ', ') pii_types, array_to_string(tags, ' ') tags,
        printf('%.2f', confidence) confidence, printf('%.1f%%', detection_rate * 100) detection_rate,
        array_to_string(shown, ', ') || case when len(vs) > 5 then printf(' (+%d more)', len(vs) - 5) else '' end samples from short""",
    "masked_samples": f"""with {_classes(_ALL, **_LOW)} select topic, field_path,
        array_to_string(list_transform(vs, lambda v: {_mask('v', 4)}), '|') sample_values from cls""",
    "topic_reports": f"""with {_classes(_ALL, **_STD)} select topic, total samples, coalesce(n, 0) pii_fields_found, coalesce(ps, '') classified
        from totals left join (select topic, count(*) n, string_agg(field_path, ',' order by field_path) ps from cls group by topic) using (topic)""",
    "find_spans": _spans("documents", "text", "doc_id"),
    "resolve_spans": f"with {_resolved('documents', 'text', 'doc_id')} select k doc_id, t pii_type, b \"start\", e \"end\", substring(text, b + 1, e - b) as \"value\", c confidence from survivors join documents on k = doc_id",
    "resolve_spans_pages": f"with {_resolved('pages', 'html', 'page_id')} select k page_id, t pii_type, b \"start\", e \"end\", substring(html, b + 1, e - b) as \"value\", c confidence from survivors join pages on k = page_id",
    "find_spans_pages": _spans("pages", "html", "page_id"),
    "find_spans_conversations": _spans("conversations", "text", "conv_id, turn"),
    "luhn_cards": f"""select doc_id, card, {_luhn('card')} as valid from (
        select doc_id, unnest(regexp_extract_all(text, '{SPAN_PATTERNS['CREDIT_CARD']}')) card from documents)""",
    "redact_text": f"select doc_id, {_redacted('text')} as text from documents",
    "redact_pages": f"select page_id, {_redacted('html')} as html from pages",
    "mask_text": _masked_text(),
    "mask_values": f"""select c_custkey, {_mask('c_name', 0)} hidden, {_mask('c_name', 4)} partly, {_mask('c_mktsegment', 9)} segment from customer""",
    "mask_classified": f"""select o_orderkey, {_mask("strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')", 4)} o_orderdate, o_orderstatus from orders""",
    "normalize_findings": f"""select doc_id, d.provider, pii_type from (select doc_id,
        list_extract(['aws', 'gcp', 'azure', 'presidio', 'model'], cast(doc_id % 5 + 1 as int)) provider,
        list_extract(['EMAIL', 'PERSON_NAME', 'IPAddress', 'LOCATION', 'dob', 'UNKNOWN', 'IBAN_CODE'], cast(doc_id % 7 + 1 as int)) entity
        from documents) d join {_ENTITIES} m(provider, entity, pii_type) on d.provider = m.provider and d.entity = m.entity""",
    "likelihood": f"""select doc_id, cast(coalesce(c, 0.5) as double) confidence from (select doc_id, list_extract(
        ['VERY_UNLIKELY', 'UNLIKELY', 'POSSIBLE', 'LIKELY', 'VERY_LIKELY', 'OTHER'], cast(doc_id % 6 + 1 as int)) w from documents) d
        left join {_values(list(LIKELIHOOD.items()))} m(w, c) on d.w = m.w""",
    "slice_spans": """select doc_id, substring(text, b + 1, greatest(e - b, 0)) as value from (select doc_id, text,
        case when doc_id % 4 = 0 then 0 else doc_id % 50 end b, case when doc_id % 5 = 0 then length(text) else doc_id % 50 + 12 end e from documents)""",
    "whole_value_spans": """select c_custkey, c_name as value, c_name pattern_matched from customer where c_custkey % 3 < 2""",
    "uncovered_fields": f"with {_kept(_ORDERS_CUSTOMER)} {_UNCOVERED}",
    "build_prompts": f"""with {_kept(_ORDERS_CUSTOMER)}, un as ({_UNCOVERED}),
        w as (select f.* from f join un on f.topic = un.topic and f.path = un.field_path),
        recs as (select topic, part, off, row_number() over (partition by topic order by part, off) rn
            from (select distinct topic, part, off from w) qualify rn <= 10),
        vals as (select w.topic, path, v, row_number() over (partition by w.topic, path order by rn) k from w join recs
            on w.topic = recs.topic and w.part = recs.part and w.off = recs.off where v <> '' and length(v) < 200),
        shown as (select topic, path, string_agg(v, ', ' order by k) s from vals where k <= 3 group by topic, path)
        select un.topic, count(*) field_count, string_agg('- ' || field_path || coalesce(': [' || s || ']', ''), chr(10) order by field_path) fields_text
        from un left join shown on un.topic = shown.topic and un.field_path = shown.path group by un.topic""",
    "parse_schema_responses": f"""select 'customer' topic, field_path, pii_type, confidence, confidence < 0.9 needs_value_check, count(*) n
        from (select * from ({_ANSWERS}) a join customer using (c_custkey) where not (field_path = 'c_name' and length(c_mktsegment) % 2 = 0
        and false)) group by all""",
    "parse_field_responses": """select o_orderkey as "offset", t pii_type, round(least(1.0, o_custkey / 1000.0), 6) confidence, o_orderpriority as value
        from (select *, list_extract(['CREDIT_CARD', null, 'IBAN', null], cast(o_orderkey % 4 + 1 as int)) t0 from orders) o,
        lateral (select case when o_orderkey % 4 = 1 then 'EMAIL' else t0 end t) where t is not null and o_orderkey % 3 <> 0""",
    "eligible_values": "select doc_id from documents where length(text) >= 3",
    "verification_gate": """with a as (select 'f' || p_partkey field_path, p_partkey k, cast(p_size * 2 as double) / 100 c, p_size * 2 < 90 chk from part
            where p_partkey % 10 <> 0),
        j as (select *, c >= 0.85 or not chk direct, k % 3 <> 0 and k % 4 <> 1 and (k % 11) / 10 > 0.6 ok from a)
        select field_path, 'NAME' pii_type, case when direct then c else (k % 11) / 10 end confidence,
        case when direct then '[schema-based detection]' else '[value-verified detection]' end as value from j where direct or ok""",
    "spread_findings": f"""with best as (select field_path, pii_type, max(confidence) confidence from ({_ANSWERS}) group by all)
        select 'customer' topic, c_custkey as "offset", field_path, pii_type, confidence, '[schema-based detection]' as value, 1 hit_no
        from customer, best""",
    "detect_with_providers": f"""with {_kept(_table_fields(['part', 'orders']), TYPE_NAMES)} select {_OUT}, 'pattern' provider from det
        union all select topic, off, path, 'USERNAME', 0.6, v, v, 'brands' from f where v like 'Brand#%'""",
    "tag_annotations": f"""with {_classes(_ALL, **_LOW)} select topic, field_path,
        'PII: ' || array_to_string(list_sort(types), ', ') || printf(' (confidence: %.2f)', confidence) doc from cls""",
    "subject_metadata": f"""with {_classes(_ALL, **_LOW)}, t as (select topic, string_agg(distinct tag, ',' order by tag) tags from
            (select topic, unnest(tags) tag from cls) group by topic)
        select topic || '-value' subject, t.tags, string_agg(field_path, ',' order by field_path) pii_fields,
        printf('%.2f', avg(confidence)) classification_confidence, count(*) fields_tagged from cls join t using (topic) group by topic, t.tags""",
    "tag_schema": f"""with {_classes(_table_fields(['orders']), **_STD)} select field, case when types is not null then
        'PII: ' || array_to_string(list_sort(types), ', ') || printf(' (confidence: %.2f)', confidence) end "comment",
        cast((select count(*) from cls) as int) fields_tagged, (select count(*) from orders) table_rows
        from (select unnest(string_split('{_avro('orders')}', ', ')) field) left join cls on field = field_path""",
    "path_matches": f"with {_classes(_table_fields(['orders']), **_STD)} select field_path, detection_count from cls",
    "tag_catalog": f"""with {_classes(_ALL, **_STD)}, hit as (select topic, count(*) n from cls group by topic)
        select topic || '-value' subject, topic in ('orders', 'events') success,
        cast(case when topic in ('orders', 'events') then n else 0 end as int) fields_tagged,
        cast(case when topic in ('orders', 'events') then 2 end as int) schema_version,
        cast(case topic when 'events' then 4 when 'orders' then 5 end as int) schema_id, topic in ('orders', 'events') metadata_applied,
        case when topic = 'words' then 'schema of words-value has no fields' when topic not in ('orders', 'events')
        then 'no schema found for subject ' || topic || '-value' else '' end errors from hit""",
    "backup_schemas": f"""with {_classes(_ALL, **_STD)} select distinct topic || '-value' subject, 1 as "version",
        case topic when 'events' then 1 else 2 end schema_id, case topic when 'events' then '{_avro_schema('events')}'
        else '{_avro_schema('orders')}' end as "schema" from cls where topic in ('events', 'orders')""",
    "schema_provider": f"""with {_kept(_ORDERS_CUSTOMER)} select topic, cast(off as bigint) as "offset", path field_path, 'NAME' pii_type,
        cast(0.9 as double) confidence, '[schema-based detection]' as value, 'schema' pattern_matched, 1 hit_no from f
        where (topic, path) in ({_UNCOVERED}) and regexp_matches(path, '(status|segment)$')""",
    "stream_latest": f"""select topic, cast(part as int) "partition", off as "offset" from ({_EVENTS}) where topic = 'click'""",
    "stream_detect": f"with {_kept(_PROFILE_FIELDS)} select {_OUT} from det",
    "stream_message_types": f"""with {_kept(_PROFILE_FIELDS)} select topic, cast(off as bigint) as "offset",
        string_agg(distinct t, ',' order by t) pii_types from det group by topic, off""",
    "dead_letters": f"""select topic, cast(part as int) "partition", off as "offset", source as value from ({_PROFILES}) where plain""",
    "stream_stats": f"""select topic, count(*) filter (not plain) processed, count(*) filter (plain) errors from ({_PROFILES}) group by topic""",
    "next_offsets": f"""select topic, cast(part as int) "partition", max(off) + 1 next_offset from ({_EVENTS}) group by topic, part""",
    "resume_offsets": f"""with e as ({_EVENTS}), seen as (select topic, part, max(off) + 1 nxt from e
            where ts < timestamp '2024-01-10 00:00:00' group by topic, part)
        select e.topic, cast(e.part as int) "partition", off as "offset" from e left join seen on e.topic = seen.topic and e.part = seen.part
        where off >= coalesce(nxt, 0)""",
    "failure_streaks": f"""with {_ISLANDS} select topic, cast(0 as int) "partition", start_offset, end_offset, failures, failures >= 5 tripped from runs""",
    "stream_streaks": f"""with {_ISLANDS}, ends as (select topic, max(off) last_off from ev group by topic)
        select ends.topic, cast(0 as int) "partition", coalesce(max(failures) filter (end_offset = last_off), 0) streak,
        coalesce(max(failures), 0) longest, coalesce(max(failures), 0) >= 5 tripped from ends left join runs on ends.topic = runs.topic group by ends.topic""",
    "classify_arrays": f"""with {_classes(_LIST_FIELDS, **_LIST_CLS)} select {_SHOW} from cls""",
    "run_errors": """select 'part' topic, 'flaky' provider, case when p_brand like 'Brand#1%' then 'ValueError: cannot read' end error, count(*) n
        from part where p_brand like 'Brand#%' group by all""",
    "stream_classify": f"with {_classes(_PROFILE_FIELDS, **_PROFILE_CLS)} select {_SHOW} from cls",
    "stream_tag": f"""with {_classes(_PROFILE_FIELDS, **_PROFILE_CLS)} select l.lang || '-value' subject, case when cls.topic is null
        then '{_DOC_SCHEMA}' else '{_DOC_TAGGED}' end as "schema" from (select distinct lang from documents) l
        left join cls on cls.topic = l.lang and field_path = 'contact.email'""",
    "monitor_stream": f"""with {_classes(_WINDOWED, **_WINDOW_CLS)}, shown as (select {_WINDOW_SHOW} from cls)
        select * from shown where window_start + interval 5 minute <=
        (select timestamp '2024-01-01 00:00:00' + to_seconds(max(doc_id)) - interval 1 minute from documents)""",
    "monitor_windows": f"with {_classes(_WINDOWED, **_WINDOW_CLS)} select {_WINDOW_SHOW} from cls",
}
ORACLE["write_report"] = ORACLE["topic_reports"]
ORACLE["detect_with_columns"] = ORACLE["detect_with_providers"]
