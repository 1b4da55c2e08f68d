"""Queries of this subpackage and their SQL; each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, jaccard_join, masked_lm, mixing, quality_rules, sharding, subword_quality, token_counts, toxicity, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", *quality_rules.BASE, "base_failed", "kept")


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


def op4_stratified_interleaving(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.interleave(table(spark, sf_dir, "documents")).drop("source")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("n_tokens")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list: every page of a host with a hyphenated name."""
    pages = table(spark, sf_dir, "pages")
    return url_filter.filter_urls(pages, pages.filter(F.col("url").rlike("://[^/?#]*-")).select("url"))


OP6_SQL = """
WITH p AS (SELECT page_id, CASE WHEN contains(url, '://') THEN url[strpos(url, '://') + 3 :] END AS rest FROM pages),
h AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM p),
c AS (SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, '^www[.]', '') || regexp_replace(regexp_replace(path, '[.]html$', ''), '/+$', '') END AS canon FROM h),
r AS (SELECT *, CASE WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/' WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule FROM c),
l AS (SELECT *, canon IS NOT NULL AND canon IN (SELECT canon FROM c WHERE contains(host, '-')) AS is_listed FROM r)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN is_listed THEN 'block' ELSE 'allow' END AS verdict, is_listed FROM l
"""


#: Target shares of the mixture's tokens in op7.
MIXTURE = {"clean": 0.9, "toxic": 0.06, "junk": 0.04}


def op7_soft_membership_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), MIXTURE)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subword_quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_masked_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masked_lm.pseudo_likelihood(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard_join, op2_quality_rules, op3_benchmark_decontamination, op4_stratified_interleaving, op5_toxicity,
        op6_url_filter, op7_soft_membership_mixing, op8_quality_classifier, op9_masked_pseudo_likelihood, op10_token_counts,
    )
}
SQL = {"op2_quality_rules": quality_rules.oracle(), "op3_benchmark_decontamination": decontaminate.ORACLE, "op4_stratified_interleaving": sharding.oracle(), "op6_url_filter": OP6_SQL}
