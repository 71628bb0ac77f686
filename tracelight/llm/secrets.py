"""Secret scans with a trigram index.

Each rule's pattern is analysed for texts that every match must contain; their trigrams form a Boolean
query (any of several lists, all trigrams of a list). The index holds, for each trigram that some rule
asks for, the documents that have it. Intersecting postings gives each rule its candidates, which are
then searched. Rules without such trigrams search every document.
"""

from __future__ import annotations

import hashlib
import re._parser as pattern_parser
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracelight.llm.tables import row_keyed


class Rule(NamedTuple):
    """``pattern`` in the syntax that Java and Python share; ``group`` is measured against ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: The first three are the base rules, found leftmost and non-overlapping, then measured.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("stripe", r"[sr]k_(?:live|test)_[A-Za-z0-9]{16,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
)
BASE = ("assign", "access", "hex")
_MOST_TEXTS = 64


def _texts(node) -> tuple[bool, set[str]]:
    """Texts of a parsed pattern: (True, all it can match) or (False, one of which every match contains)."""
    exact, held, best = True, {""}, set()

    def weight(found: set[str]) -> int:
        return min(map(len, found), default=0)

    for op, value in node:
        name = str(op)
        if name == "LITERAL":
            whole, own = True, {chr(value).lower()}
        elif name == "IN" and len(value) <= 8 and all(str(o) == "LITERAL" for o, _ in value):
            whole, own = True, {chr(v).lower() for _, v in value}
        elif name == "SUBPATTERN":
            whole, own = _texts(value[-1])
        elif name == "BRANCH":
            parts = [_texts(p) for p in value[1]]
            whole = all(w for w, _ in parts)
            own = set().union(*(t for _, t in parts))
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            least, most, inner = value
            w, t = _texts(inner)
            if (least, most) == (0, 1) and w:
                whole, own = True, t | {""}
            elif (least, most) == (1, 1):
                whole, own = w, t
            else:
                whole, own = False, t if least else {""}
        elif name == "AT":
            continue
        else:
            whole, own = False, {""}
        if whole and len(held) * len(own) <= _MOST_TEXTS:
            held = {h + o for h in held for o in own}
            continue
        exact = False
        best = max(best, held, own, key=weight)
        held = own if whole else {""}
    if exact:
        return True, held
    return False, max(best, held, key=weight)


def trigram_query(pattern: str) -> list[list[str]]:
    """Lists of lower-case trigrams; every match has all of at least one list. Empty: nothing is certain."""
    _, texts = _texts(pattern_parser.parse(pattern))
    if min(map(len, texts), default=0) < 3:
        return []
    return sorted({tuple(sorted({t[i : i + 3] for i in range(len(t) - 2)})) for t in texts})


def postings(rows: DataFrame, trigrams: list[str]) -> DataFrame:
    """The inverted index: (trigram, rid) for each trigram asked for and each row whose lower-case text has it."""
    asked = F.array(*[F.when(F.contains(F.col("low"), F.lit(t)), F.lit(t)) for t in trigrams])
    return rows.select("rid", F.lower("text").alias("low")).select(
        F.explode(F.array_compact(asked)).alias("trigram"), "rid"
    )


def candidates(rows: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """rid and ``asked``: the kinds of the rules whose trigram query the row's postings fulfil."""
    terms = [(r.kind, i, t, len(q)) for r in rules for i, q in enumerate(trigram_query(r.pattern)) for t in q]
    index = postings(rows, sorted({t for _, _, t, _ in terms}))
    query = rows.sparkSession.createDataFrame(terms, "kind string, list int, trigram string, need int")
    return (
        index.join(F.broadcast(query), "trigram")
        .groupBy("rid", "kind", "list")
        .agg(F.count("*").alias("have"), F.first("need").alias("need"))
        .filter("have = need")
        .groupBy("rid")
        .agg(F.collect_set("kind").alias("asked"))
    )


def _matches(rule: Rule, number: int, when: Column) -> Column:
    """Matches of one rule in ``text``, in order: (number, place, skip, size, got), where skip is the length
    of the text since the match before, size that of the match and got that of the group it is measured by."""
    pattern = F.lit(rule.pattern)
    pieces = F.arrays_zip(
        F.split("text", pattern, -1).alias("b"),
        F.regexp_extract_all("text", pattern, F.lit(0)).alias("f"),
        F.regexp_extract_all("text", pattern, F.lit(rule.group)).alias("g"),
    )
    each = F.transform(
        pieces,
        lambda x, i: F.struct(
            F.lit(number).alias("number"),
            i.alias("place"),
            F.length(x["b"]).alias("skip"),
            F.length(x["f"]).alias("size"),
            F.length(x["g"]).alias("got"),
        ),
    )
    return F.when(when & F.col("text").rlike(rule.pattern), each)


def find_secrets(rows: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(rid, start, number, end) of all matches long enough, in code points, end exclusive.

    Places are sums of the lengths before, taken per row and rule once the texts are gone.
    """
    numbered = list(enumerate(rules))
    indexed = [(n, r) for n, r in numbered if trigram_query(r.pattern)]
    full = [(n, r) for n, r in numbered if not trigram_query(r.pattern)]
    found = []
    if indexed:
        asked = candidates(rows, tuple(r for _, r in indexed))
        checked = rows.select("rid", "text").join(asked, "rid")
        found += [(checked, [_matches(r, n, F.array_contains("asked", r.kind)) for n, r in indexed])]
    if full:
        found += [(rows.select("rid", "text"), [_matches(r, n, F.lit(True)) for n, r in full])]
    parts = [df.select("rid", F.explode(F.array_compact(F.array(*m))).alias("m")) for df, m in found]
    matches = parts[0] if len(parts) == 1 else parts[0].union(parts[1])
    pieces = matches.select("rid", F.explode("m").alias("m")).select("rid", "m.*")
    so_far = Window.partitionBy("rid", "number").orderBy("place")
    least = F.element_at(F.array(*[F.lit(r.least) for r in rules]), F.col("number") + 1)
    return (
        pieces.withColumn("end", F.sum(F.col("skip") + F.coalesce("size", F.lit(0))).over(so_far))
        .filter(F.col("size").isNotNull() & (F.col("got") >= least))
        .select("rid", (F.col("end") - F.col("size")).alias("start"), "number", "end")
    )


def scan_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES
) -> DataFrame:
    """Every row's counts of base matches, the digest of the base spans and all spans as text.

    Spans are kind:start:end, by start, then by the rules' order. Null text is empty. Rows may repeat
    or have null ids; extra columns are not looked at. An empty table gives an empty result.
    """
    keyed = row_keyed(docs, id_col, text_col)
    rows = keyed.select("rid", F.coalesce("text", F.lit("")).alias("text"))
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    spans = F.array_sort(F.collect_list(F.struct("start", "number", "end")))
    lists = find_secrets(rows, rules).groupBy("rid").agg(spans.alias("spans"))
    shown = lambda column: F.array_join(
        F.transform(column, lambda s: F.concat_ws(":", kinds[s["number"]], s["start"], s["end"])), ","
    )
    base = F.filter("spans", lambda s: s["number"] < len(BASE))
    numbers = F.transform("spans", lambda s: s["number"])
    told = lists.select(
        "rid",
        *[
            (F.size(numbers) - F.size(F.array_remove(numbers, n))).cast("long").alias(f"n_{kind}")
            for n, kind in enumerate(BASE)
        ],
        F.sha2(shown(base), 256).alias("base_sha256"),
        shown(F.col("spans")).alias("spans"),
    )
    none = hashlib.sha256(b"").hexdigest()
    return keyed.select("rid", "owner").join(told, "rid", "left").select(
        F.col("owner").alias(id_col),
        *[F.coalesce(f"n_{kind}", F.lit(0)).alias(f"n_{kind}") for kind in BASE],
        F.coalesce("base_sha256", F.lit(none)).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
    )
