"""Free text: spans of sensitive values with offsets, masking and redaction."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelight.functions.patterns import DETECTION_ORDER, VALUE_PATTERNS, luhn_ok, unlikely_ssn
from tracelight.functions.text import mask
from tracelight.schemas import PRIORITY

# Redaction order: what is more specific comes first.
SPAN_TYPES = [
    "EMAIL", "CREDIT_CARD", "NATIONAL_INSURANCE_NUMBER", "IBAN", "AWS_ACCESS_KEY", "AWS_SECRET_KEY", "MAC_ADDRESS",
    "IP_ADDRESS", "ITIN", "SSN", "DATE_OF_BIRTH", "BANK_ACCOUNT", "PHONE_NUMBER", "SWIFT_CODE", "NAME",
]


def _inside_text(pii_type: str) -> str:
    """A value pattern as it is searched inside running text: its anchors become word boundaries.

    An address may stand between any characters, so EMAIL just loses its anchors.
    """
    edge = "" if pii_type == "EMAIL" else r"\b"
    return VALUE_PATTERNS[pii_type].replace("^", edge).replace("$", edge)


SPAN_PATTERNS = {t: _inside_text(t) for t in SPAN_TYPES}

# A text without any of these shapes has no span of the type; one contains() or short regex each.
_NEEDS = {
    "EMAIL": "@",
    "CREDIT_CARD": r"\d{4}",
    "IBAN": r"[A-Z]{2}\d{2}",
    "AWS_ACCESS_KEY": "AKIA",
    "AWS_SECRET_KEY": "[A-Za-z0-9/+=]{40}",
    "MAC_ADDRESS": "[:-]",
    "IP_ADDRESS": r"\d\.\d|[0-9a-fA-F]:",
    "ITIN": r"9\d{2}[78]\d{5}",
    "SSN": r"\d{3}-\d{2}-\d{4}|\d{9}",
    "NATIONAL_INSURANCE_NUMBER": r"[A-Z]{2}\d{6}",
    "BANK_ACCOUNT": r"\d{8}",
    "SWIFT_CODE": "[A-Z]{6}[A-Z0-9]{2}",
    "NAME": r"[A-Z][a-z]+\s+[A-Z][a-z]",
    "DATE_OF_BIRTH": r"(?:19|20)\d{2}",
    "PHONE_NUMBER": r"\d{4}",
}


def text_matches(text: Column, pii_type: str) -> Column:
    """All matches of a type in running text, as an array; texts without its shape cost one short regex."""
    pattern = SPAN_PATTERNS[pii_type]
    none = F.array().cast("array<string>")
    return F.when(text.rlike(_NEEDS[pii_type]), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(
        none
    )


def _confidence_sql(pii_type: str, span: str) -> str:
    return (
        f"case when {pii_type} = 'CREDIT_CARD' then if({luhn_ok(span)}, 0.95D, 0.50D) "
        f"when {pii_type} = 'SSN' and {unlikely_ssn(span)} then 0.30D else 0.70D end"
    )


def span_confidence(pii_type: str, span: str) -> Column:
    """Confidence of a span; free text has no field name to raise it."""
    return F.expr(_confidence_sql(pii_type, span))


def find_spans(df: DataFrame, text_col: str, keys: list[str], types: list[str] | None = None) -> DataFrame:
    """Every match of every type in a text: ``pii_type, span_no, start, end, value, confidence``.

    ``start`` counts characters from 0. It is the length of everything before the match: the text
    between matches (the text split at the pattern) and the matches before it. Narrow: no shuffle,
    and texts without a match of a type cost one short regex for it.
    """
    text = F.col(text_col)
    found = [
        F.struct(F.lit(t).alias("pii_type"), F.lit(SPAN_PATTERNS[t]).alias("pattern"), text_matches(text, t).alias("m"))
        for t in types or SPAN_PATTERNS
    ]
    # Types without a match go before the text is copied for each type. inline_outer, as Catalyst
    # adds a size() > 0 filter with a second copy of the array to a generator that is not outer.
    some = F.filter(F.array(*found), lambda f: F.size(f["m"]) > 0)
    per_type = df.select(*keys, text.alias("_text"), F.inline_outer(some)).where(F.col("m").isNotNull())
    # Split per type with a literal pattern, so Spark compiles it once.
    pieces = F.lit(None).cast("array<string>")
    for t in types or SPAN_PATTERNS:
        pieces = F.when(F.col("pii_type") == t, F.split("_text", SPAN_PATTERNS[t])).otherwise(pieces)
    located = per_type.select(*keys, "pii_type", "m", pieces.alias("pieces"))
    step = F.transform(
        "m", lambda m, i: F.struct(F.length(F.get(F.col("pieces"), i)).alias("gap"), F.length(m).alias("size"))
    )
    begin = F.struct(F.array().cast("array<int>").alias("starts"), F.lit(0).alias("at"))
    starts = F.aggregate(
        step,
        begin,
        lambda acc, s: F.struct(
            F.concat(acc["starts"], F.array(acc["at"] + s["gap"])).alias("starts"),
            (acc["at"] + s["gap"] + s["size"]).alias("at"),
        ),
        lambda acc: acc["starts"],
    )
    spans = located.withColumn("starts", starts).select(
        *keys, "pii_type", F.posexplode(F.arrays_zip("m", "starts")).alias("span_no", "s")
    )
    return spans.select(
        *keys,
        "pii_type",
        "span_no",
        F.col("s.starts").alias("start"),
        (F.col("s.starts") + F.length("s.m")).alias("end"),
        F.col("s.m").alias("value"),
        span_confidence("pii_type", "s.m").alias("confidence"),
    )


def luhn_cards(df: DataFrame, text_col: str, keys: list[str]) -> DataFrame:
    """All sixteen-digit groups of a text with the result of their checksum."""
    return (
        df.select(*keys, F.explode(text_matches(F.col(text_col), "CREDIT_CARD")).alias("card"))
        .withColumn("valid", F.expr(luhn_ok("card")))
    )


def redact(text: Column, types: list[str] | None = None) -> Column:
    """Replace spans by ``[TYPE]``, more specific types first; a type's pattern only runs on texts of its shape."""

    def replaced(t: str):
        need, pattern = F.lit(_NEEDS[t]), SPAN_PATTERNS[t]
        return lambda x: F.when(F.rlike(x, need), F.regexp_replace(x, pattern, f"[{t}]")).otherwise(x)

    for t in types or SPAN_PATTERNS:
        # an array of one gives the text so far a name, so it is worked out once
        text = F.transform(F.array(text), replaced(t))[0]
    return text


def mask_spans(text: Column, types: list[str] | None = None, keep_last: int = 0) -> Column:
    """Replace spans by masks of the same length."""
    for t in types or SPAN_PATTERNS:
        pieces = F.split(text, SPAN_PATTERNS[t])
        masks = F.transform(F.regexp_extract_all(text, F.lit(SPAN_PATTERNS[t]), F.lit(0)), lambda m: mask(m, keep_last))
        joined = F.zip_with(pieces, masks, lambda p, m: F.concat(p, F.coalesce(m, F.lit(""))))
        text = F.when(text.rlike(_NEEDS[t]), F.array_join(joined, "")).otherwise(text)
    return text


class Span(NamedTuple):
    """One match in a text; sorts by place."""

    start: int
    end: int
    pii_type: str
    value: str
    confidence: float

    @property
    def strength(self) -> tuple[int, int]:
        """Conflict priority; of equal ones the type detected first."""
        return PRIORITY.get(self.pii_type, 0), -DETECTION_ORDER[self.pii_type]


def _matched(df: DataFrame, text_col: str, keys: list[str], types: list[str] | None) -> DataFrame:
    """``row`` (the keys) and per type that matches: matches, what lies before each, confidences.

    Each pattern runs in the JVM, and only on texts of its shape.
    """
    text = F.col(f"`{text_col}`")
    kinds = types or list(SPAN_PATTERNS)
    hits = df.select(F.struct(*[F.col(f"`{k}`") for k in keys]).alias("row"), text.alias("text"), *[text_matches(text, t).alias(t) for t in kinds])

    def described(t: str) -> Column:
        gaps = F.transform(F.split("text", SPAN_PATTERNS[t]), lambda x: F.length(x))
        score = F.expr(f"transform({t}, m -> {_confidence_sql(repr(t), 'm')})")
        found = F.struct(F.lit(t).alias("pii_type"), F.col(t).alias("m"), gaps.alias("gaps"), score.alias("confidence"))
        return F.when(F.size(t) > 0, found)

    return hits.select("row", F.array_compact(F.array(*map(described, kinds))).alias("found"))


def _spans(found: list[dict]) -> list[Span]:
    """All matches of a text in order; a place is the length of all gaps and matches before it."""
    spans = []
    for kind in found:
        steps = ((gap, len(m)) for gap, m in zip(kind["gaps"], kind["m"]))
        ends = accumulate(g + n for g, n in steps)
        spans += [Span(e - len(m), e, kind["pii_type"], m, c) for e, m, c in zip(ends, kind["m"], kind["confidence"])]
    return sorted(spans)


def _survivors(spans: list[Span]) -> list[Span]:
    """Spans that no overlapping span of another type beats, each judged against all of them.

    The rules are those for findings of one value: a card removes phone numbers and dates, and the
    strongest rival removes what has a lower priority and no higher confidence. One sweep in order of
    place; a span only meets those that begin before it ends.
    """
    rivals: list[Span | None] = [None] * len(spans)
    carded = [False] * len(spans)
    for i, one in enumerate(spans):
        for j in range(i + 1, len(spans)):
            other = spans[j]
            if other.start >= one.end:
                break
            if other.pii_type == one.pii_type:
                continue
            for own, rival in ((i, other), (j, one)):
                carded[own] |= rival.pii_type == "CREDIT_CARD"
                if rivals[own] is None or rival.strength > rivals[own].strength:
                    rivals[own] = rival
    return [
        s
        for s, r, card in zip(spans, rivals, carded)
        if not (card and s.pii_type in ("PHONE_NUMBER", "DATE_OF_BIRTH"))
        and not (r and r.strength[0] > s.strength[0] and r.confidence >= s.confidence)
    ]


_RESOLVED = pa.list_(
    pa.struct([("start", pa.int32()), ("end", pa.int32()), ("pii_type", pa.string()), ("value", pa.string()), ("confidence", pa.float64())])
)


def _resolved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        some = [i for i, f in enumerate(batch.column("found").to_pylist()) if f]
        batch = batch.take(pa.array(some, pa.int64()))
        spans = [[s._asdict() for s in _survivors(_spans(f))] for f in batch.column("found").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(spans, _RESOLVED)], names=["row", "spans"])


def resolve_spans(df: DataFrame, text_col: str, keys: list[str], types: list[str] | None = None) -> DataFrame:
    """Spans of a text without those that an overlapping span of another type beats. Narrow: no shuffle.

    ``pii_type, start, end, value, confidence``. Conflicts are settled as between findings of one value, so
    a valid card number is a card only; spans of equal priority coexist. Types that are not looked for
    beat nothing. Null texts have no spans.
    """
    rows = _matched(df, text_col, keys, types)
    span = T.StructType(
        [T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("pii_type", T.StringType()),
         T.StructField("value", T.StringType()), T.StructField("confidence", T.DoubleType())]
    )
    # (no filter on found: it would be pushed down, with a copy of all the patterns)
    found = rows.mapInArrow(_resolved, T.StructType([rows.schema["row"], T.StructField("spans", T.ArrayType(span))]))
    opened = found.select("row", F.explode("spans").alias("s"))
    return opened.select(*[F.col(f"row.`{k}`").alias(k) for k in keys], "s.pii_type", "s.start", "s.end", "s.value", "s.confidence")


def redact_text(df: DataFrame, text_col: str, types: list[str] | None = None, style: str = "type", keep_last: int = 0) -> DataFrame:
    """The table with its text column redacted (``style="type"``) or masked (``style="mask"``).

    Types are replaced one after the other, the more specific first, so what a stronger type only covers
    in part is still replaced where it matches; nothing is left over as with cuts at resolved spans.
    """
    if style == "type":
        return df.withColumn(text_col, redact(F.col(text_col), types))
    out = df
    for t in types or SPAN_PATTERNS:
        # One step per type: the masked text is used several times in the next step.
        out = out.withColumn(text_col, mask_spans(F.col(text_col), [t], keep_last))
    return out


def mask_columns(df: DataFrame, columns: list[str], keep_last: int = 0) -> DataFrame:
    """Mask whole columns, for example the classified ones of a table."""
    return df.withColumns({c: mask(F.col(f"`{c}`").cast("string"), keep_last) for c in columns})


def mask_classified(df: DataFrame, cls: DataFrame, topic: str, keep_last: int = 0) -> DataFrame:
    """Mask the columns of a table that were classified; the list is at most its column count."""
    hits = cls.where((F.col("topic") == topic) & F.col("field_path").isin(*df.columns))
    names = [r["field_path"] for r in hits.select("field_path").distinct().collect()]
    return mask_columns(df, sorted(names), keep_last)
