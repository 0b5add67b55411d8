"""Version history as a data source (S14): ``spark.read.format("git_log")``."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.aggregates import co_occurring

SCHEMA = "hash string, author string, at long, subject string, path string"


class GitLog(DataSource):
    """Commits of a repository, one row a changed file. Options: path, limit."""

    @classmethod
    def name(cls) -> str:
        return "git_log"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return GitLogReader(self.options.get("path", "."), int(self.options.get("limit", "20")))


class GitLogReader(DataSourceReader):
    def __init__(self, path: str, limit: int):
        self.path, self.limit = path, limit

    def partitions(self):
        return [InputPartition(0)]

    def read(self, partition):
        log = subprocess.run(["git", "-C", self.path, "log", f"-n{self.limit}", "--name-only", "--format=%x01%H%x02%an%x02%at%x02%s"], capture_output=True, text=True, check=True).stdout
        for commit in log.split("\x01")[1:]:
            head, _, body = commit.partition("\n")
            digest, author, at, subject = head.split("\x02")
            for path in filter(None, body.split("\n")):
                yield digest, author, int(at), subject, path


def log(spark: SparkSession, path: str, limit: int = 20) -> DataFrame:
    spark.dataSource.register(GitLog)
    return spark.read.format("git_log").option("path", path).option("limit", str(limit)).load()


def co_changes(commits: DataFrame, least: int = 2) -> DataFrame:
    """Files changed together in ``least`` commits or more."""
    return co_occurring(commits, "hash", "path", least)


def velocity(commits: DataFrame) -> DataFrame:
    """Commits and files by day."""
    day = F.to_date(F.timestamp_seconds("at"))
    return commits.groupBy(day.alias("day")).agg(F.count_distinct("hash").alias("commits"), F.count("*").alias("changes"), F.count_distinct("path").alias("files"))
