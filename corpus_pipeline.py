"""The corpus pipeline: quality rules, quality classifier, line dedup, near
duplicates, packing. Each stage takes the documents its predecessor kept.

All stages but the last return the columns they were given, whatever their names,
in order. A null text is an empty text: without words, so the rules reject it. A
null id is an id like others, but never learnt from. Rows that repeat are judged
alike by rules and classifier, keep each other's lines, and of equal texts one
stays at the near-duplicate stage. Without labels of both classes no model is
fitted: the base rules alone decide, then the classifier keeps all. Empty tables
give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.llm import common, jaccard, linededup, packing, quality_pu, quality_rules


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep(docs, quality_rules.train(docs, _labels(spark, sf_dir)))


def by_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    return quality_pu.keep(docs, quality_pu.train(docs, _labels(spark, sf_dir)))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of line runs, n_chars brought up to date;
    documents of which nothing is left go."""
    out = linededup.stage(docs)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return jaccard.keep_first(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents packed into sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", by_rules),
    ("quality_classifier", by_classifier),
    ("line_dedup", without_repeated_lines),
    ("ngram_jaccard", one_of_each_group),
    ("packing", packed),
]

#: The models' scores can't be expressed in SQL; the tests hold the pipeline
#: against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
