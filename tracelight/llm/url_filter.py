"""URL rules by hashed host and path expressions.

A rule names a host and a path; it fits that host and its subdomains where the path starts with the
rule's. Each distinct URL is expanded into host suffixes times path prefixes, of the shapes that
rules have. Expressions and rules meet by the first bytes of their SHA-256; the whole digest confirms.
Of all rules that fit, the longest decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (host, path, verdict)
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
DEFAULT_VERDICT = "allow"
PREFIX_DIGITS = 8
#: Rule tables of at most this many rows are broadcast; larger ones are joined by shuffle.
BROADCAST_RULES = 100_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def url_host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or where there is no ``://``."""
    at = F.locate("://", url)
    rest = F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))
    return ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_extract(rest, "^[^/?#]*(/[^?#]*)", 1)


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, path), 256)


def matching_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The deciding rule of each row of ``urls`` (host, path: distinct) that has one.

    Longest rule first; of rules of one length the one of the longer host, then ``block``.
    """
    known = (
        rules.filter("host is not null and path is not null and verdict is not null")
        .groupBy(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"))
        .agg(F.max("verdict").alias("verdict"))
    )
    # shapes, not rules: at most the labels of a host and the lengths of a path
    shapes = known.agg(
        F.collect_set(F.size(F.split("rule_host", r"\."))).alias("labels"),
        F.collect_set(F.length("rule_path")).alias("lengths"),
    ).first()
    hosts = F.filter(
        F.transform(F.array([F.lit(n) for n in sorted(shapes["labels"])]), lambda n: F.struct(n.alias("n"))),
        lambda s: s["n"] <= F.size(F.split("host", r"\.")),
    )
    paths = F.filter(F.array([F.lit(n) for n in sorted(shapes["lengths"])]), lambda n: n <= F.length("path"))
    if not shapes["labels"]:
        return urls.select("host", "path", F.lit("").alias("rule"), F.lit("").alias("verdict")).limit(0)
    expressions = (
        urls.withColumn("labels", F.explode(hosts))
        .withColumn("size", F.explode(paths))
        .withColumn("suffix", F.expr("substring_index(host, '.', -labels.n)"))
        .withColumn("full", _digest(F.col("suffix"), F.expr("substring(path, 1, size)")))
        .select("host", "path", "full", F.substring("full", 1, PREFIX_DIGITS).alias("short"))
    )
    keyed = known.withColumn("rule_full", _digest(F.col("rule_host"), F.col("rule_path"))).withColumn(
        "short", F.substring("rule_full", 1, PREFIX_DIGITS)
    )
    if keyed.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES:
        keyed = F.broadcast(keyed)
    rank = F.struct(F.length(F.concat("rule_host", "rule_path")), F.length("rule_host"), F.col("verdict"))
    chosen = F.max_by(F.struct(F.concat("rule_host", "rule_path").alias("rule"), "verdict"), rank).alias("best")
    return (
        expressions.join(keyed, "short")
        .filter(F.col("full") == F.col("rule_full"))
        .groupBy("host", "path")
        .agg(chosen)
        .select("host", "path", "best.rule", "best.verdict")
    )


def judge_urls(
    pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = DEFAULT_VERDICT
) -> DataFrame:
    """Every row's id, host, path, deciding rule (null if none fits) and verdict (else ``default``).

    Null urls and urls without ``://`` have an empty host and path. Rows stay as they are, repeated
    or with null ids; extra columns are not looked at. Rules with a null part are left out; a rule
    given twice with both verdicts blocks. Without rules every row gets the default.
    """
    host, path = url_host_path(F.col(url_col))
    rows = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    best = matching_rules(rows.select("host", "path").distinct(), rules)
    return rows.join(best, ["host", "path"], "left").select(
        id_col, "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict")
    )
