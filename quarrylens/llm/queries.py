"""The queries of this subpackage, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, fingerprint, jaccard, licenses, linededup, packing, quality_pu, quality_rules, tokenfile, urls
from .common import documents


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare(documents(spark, sf_dir))


def fingerprint_likeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op3's columns that SQL can express."""
    return op3_fingerprints(spark, sf_dir).drop("fingerprint", "edited_fingerprint")


def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op5's columns that SQL can express: its base counts."""
    return op5_quality_rules(spark, sf_dir).drop("kept", "quality_p")


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op7's columns that SQL can express: what the rules say."""
    out = op7_url_filters(spark, sf_dir)
    return out.select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("rule_verdict"))


def license_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op8's columns that SQL can express: the phrases' places."""
    return op8_license_scans(spark, sf_dir).drop("labels", "score")


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality_rules.score(docs, quality_rules.train(docs, _labels(spark, sf_dir)))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality_pu.score(docs, quality_pu.train(docs, _labels(spark, sf_dir)))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op8_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir)).drop("spans")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", F.col("_ld_lines").alias("n_lines"), F.col("_ld_removed").alias("n_removed"), F.coalesce("text", F.lit("")).alias("text"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.written_and_read(spark, documents(spark, sf_dir))


QUERIES = {
    "fingerprint_likeness": fingerprint_likeness,
    "quality_counts": quality_counts,
    "url_rules": url_rules,
    "license_phrases": license_phrases,
    "op1_packing": op1_packing,
    "op2_bpe": op2_bpe,
    "op3_fingerprints": op3_fingerprints,
    "op4_ngram_jaccard": op4_ngram_jaccard,
    "op7_url_filters": op7_url_filters,
    "op8_license_scans": op8_license_scans,
    "op9_line_dedup": op9_line_dedup,
    "op10_token_files": op10_token_files,
    "op5_quality_rules": op5_quality_rules,
    "op6_quality_classifier": op6_quality_classifier,
}

ORACLE_SQL: dict[str, str] = {
    "fingerprint_likeness": fingerprint.SQL,
    "quality_counts": quality_rules.SQL,
    "url_rules": urls.SQL,
    "license_phrases": licenses.SQL,
    "op4_ngram_jaccard": jaccard.SQL,
    "op9_line_dedup": linededup.SQL,
}
