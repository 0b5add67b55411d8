"""Knowledge, configuration and audit documents as tables."""

from __future__ import annotations

import dataclasses
import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ITEMS = "id string, title string, category string, content string, tags array<string>, confidence double, usage_count long"
FINDINGS = "finding_id string, finding_type string, severity string, confidence double, file_path string, line_start int, line_end int, title string"


def knowledge(spark: SparkSession, path: str) -> DataFrame:
    """Knowledge items: a JSON array of objects, or one object a file."""
    return spark.read.schema(ITEMS).json(path, multiLine=True).where("id IS NOT NULL")


def found(items: DataFrame, text: str) -> DataFrame:
    """Items that hold the text in any field, lower-cased (F17), best first."""
    hit = F.lower(F.concat_ws(" ", "title", "category", "content", F.array_join("tags", " "))).contains(text.lower())
    return items.where(hit).orderBy(F.desc("confidence"), "id")


def statistics(items: DataFrame) -> DataFrame:
    """Items, uses and confidence by category."""
    return items.groupBy("category").agg(F.count("*").alias("n"), F.sum("usage_count").alias("uses"), F.avg("confidence").alias("mean_confidence"))


def audit_findings(spark: SparkSession, path: str) -> DataFrame:
    """Findings of audit documents, with POSIX paths."""
    raw = spark.read.json(path, multiLine=True, schema=f"findings array<struct<{', '.join(c.replace(' ', ': ', 1) for c in FINDINGS.split(', '))}>>")
    return raw.select(F.explode("findings").alias("f")).select("f.*").withColumn("file_path", F.regexp_replace("file_path", r"\\", "/"))


@dataclasses.dataclass(frozen=True)
class Settings:
    """Settings of an audit."""

    include: str = "*.py"
    exclude: tuple[str, ...] = ()
    least_clone_lines: int = 3
    least_confidence: float = 0.5
    near_lines: int = 10

    @classmethod
    def load(cls, path: str | None = None, environment: dict[str, str] | None = None, prefix: str = "QUARRYLENS_") -> Settings:
        """From a JSON file, then from variables such as QUARRYLENS_NEAR_LINES."""
        given: dict = {}
        if path:
            with open(path, encoding="utf-8") as f:
                given |= json.load(f)
        for field in dataclasses.fields(cls):
            value = (os.environ if environment is None else environment).get(prefix + field.name.upper())
            if value is not None:
                given[field.name] = value
        kinds = {f.name: type(f.default) for f in dataclasses.fields(cls)}
        if unknown := sorted(given.keys() - kinds.keys()):
            raise ValueError(f"unknown settings: {unknown}")
        make = lambda k, v: tuple(v.split(",") if isinstance(v, str) else v) if kinds[k] is tuple else kinds[k](v)
        return cls(**{k: make(k, v) for k, v in given.items()})
