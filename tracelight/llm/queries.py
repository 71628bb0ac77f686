"""Registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelight.llm import centroids
from tracelight.llm.centroids import cluster_vectors
from tracelight.llm.decontaminate import find_passages
from tracelight.llm.language import identify_documents
from tracelight.llm.mixing import DOMAINS, mix_documents
from tracelight.llm.periodic import find_runs, with_echoes
from tracelight.llm.quality import judge_quality
from tracelight.llm.secrets import scan_documents
from tracelight.llm.sharding import assign_shards
from tracelight.llm.simhash import link_documents
from tracelight.llm.substring_dedup import remove_passages
from tracelight.llm.suffix_dedup import remove_repeats
from tracelight.llm.tables import read_docs
from tracelight.llm.toxicity import judge_toxicity
from tracelight.llm.url_filter import RULES, judge_urls, rule_table


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read_docs(spark, sf_dir))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(read_docs(spark, sf_dir, "pages"), rule_table(spark, RULES))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_documents(read_docs(spark, sf_dir)).drop("rid")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_documents(read_docs(spark, sf_dir), read_docs(spark, sf_dir, "labels"))
    posterior = [F.col(f"p{k}").alias(f"p_{name}") for k, name in enumerate(DOMAINS)]
    return mixed.select(F.col("owner").alias("doc_id"), F.col("tokens").alias("n_tokens"), *posterior, "rate")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_docs(spark, sf_dir).select("doc_id", "text")
    found = find_passages(docs, read_docs(spark, sf_dir, "benchmark"))
    return found.select("row.doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_passages(read_docs(spark, sf_dir))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = identify_documents(read_docs(spark, sf_dir))
    return found.select(F.col("owner").alias("doc_id"), "lang", "posterior", "n_trigrams", "kept")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(read_docs(spark, sf_dir))


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_documents(read_docs(spark, sf_dir))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_docs(spark, sf_dir).select("doc_id", "text")
    return judge_quality(docs, read_docs(spark, sf_dir, "labels")).select("row.doc_id", "*").drop("row")


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_toxicity(read_docs(spark, sf_dir), read_docs(spark, sf_dir, "labels"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(read_docs(spark, sf_dir, "embeddings"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_runs(with_echoes(read_docs(spark, sf_dir)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_suffix_dedup,
        op2_url_filters,
        op3_simhash,
        op4_mixing,
        op5_decontamination,
        op6_substring_dedup,
        op7_language_id,
        op8_sharding,
        op9_secret_scans,
        op10_quality_rules,
        op11_toxicity,
        op12_centroid_clustering,
        op13_periodic_runs,
    )
}

_RULE_ROWS = ", ".join(f"('{host}', '{path}', '{verdict}')" for host, path, verdict in RULES)

ORACLE: dict[str, str] = {
    "op12_centroid_clustering": centroids.ORACLE,
    "op2_url_filters": f"""
        WITH cut AS (
            SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
            FROM pages
        ), parts AS (
            SELECT page_id,
                translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1) AS path
            FROM cut
        ), rules(rule_host, rule_path, verdict) AS (VALUES {_RULE_ROWS})
        SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict
        FROM (
            SELECT page_id, host, path, (
                SELECT {{'rule': rule_host || rule_path, 'verdict': verdict}} FROM rules
                WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
                ORDER BY length(rule_host || rule_path) DESC LIMIT 1
            ) AS best
            FROM parts
        )""",
}
