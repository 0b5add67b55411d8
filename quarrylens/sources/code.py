"""Source-code scans and change detection.

Spark's own file sources leave out names that begin with an underscore, and so
every ``__init__.py``; the scan is therefore a data source of its own, over any
file system that pyarrow can open. It lists names on the driver and reads
contents in tasks; as a stream it goes on after the last file it has seen.
"""

from __future__ import annotations

import fnmatch
import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..shipping import ship
from ..values import DISCOVERY_EXCLUDED, DISCOVERY_SKIPPED, INDEX_SKIPPED

#: Larger files are not parsed (a row in the errors says so).
MOST_BYTES = 10 * 1024 * 1024


#: Files to a task.
PER_TASK = 64


def _store(root: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(root if "://" in root else os.path.abspath(root))


def _listed(root: str, include: str, skipped: set[str]) -> list[tuple[int, str, int]]:
    """(time of change, path below the root, size), in that order."""
    from pyarrow import fs

    store, base = _store(root)
    out = []
    for f in store.get_file_info(fs.FileSelector(base, recursive=True)):
        path = f.path[len(base.rstrip("/")) + 1 :]
        parts = path.split("/")
        if f.is_file and fnmatch.fnmatch(parts[-1], include) and not skipped & set(parts[:-1]):
            out.append((f.mtime_ns or 0, path, f.size))
    return sorted(out)


class _Files(InputPartition):
    def __init__(self, found):
        super().__init__(found)
        self.found = found


def _contents(root: str, partition: _Files):
    store, base = _store(root)
    for changed, path, size in partition.found:
        content = None
        if size <= MOST_BYTES:
            with store.open_input_stream(f"{base.rstrip('/')}/{path}") as f:
                content = f.read()
        yield path, size, changed, content


def _split(found) -> list[_Files]:
    return [_Files(found[k : k + PER_TASK]) for k in range(0, len(found), PER_TASK)]


class SourceFiles(DataSource):
    """Options: path, include (a name pattern), skipped (folders, by commas)."""

    @classmethod
    def name(cls) -> str:
        return "source_files"

    def schema(self) -> str:
        return "file_path string, file_size long, changed long, content binary"

    def _where(self):
        skipped = self.options.get("skipped", ",".join(INDEX_SKIPPED))
        return self.options["path"], self.options.get("include", "*.py"), set(skipped.split(","))

    def reader(self, schema) -> DataSourceReader:
        return _Reader(*self._where())

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(*self._where())


class _Reader(DataSourceReader):
    def __init__(self, root, include, skipped):
        self.root, self.include, self.skipped = root, include, skipped

    def partitions(self):
        return _split(_listed(self.root, self.include, self.skipped))

    def read(self, partition):
        if partition is not None:
            yield from _contents(self.root, partition)


class _StreamReader(DataSourceStreamReader):
    """Offsets are the time of change and the path of the last file seen: for
    folders that files are written into. A file moved in with an older time is
    not seen; an index that must see it, and deletions, compares hashes
    (``incremental.update``)."""

    def __init__(self, root, include, skipped):
        self.root, self.include, self.skipped = root, include, skipped

    def initialOffset(self):
        return {"changed": -1, "path": ""}

    def latestOffset(self):
        found = _listed(self.root, self.include, self.skipped)
        return {"changed": found[-1][0], "path": found[-1][1]} if found else self.initialOffset()

    def partitions(self, start, end):
        lo, hi = ((x["changed"], x["path"]) for x in (start, end))
        return _split([f for f in _listed(self.root, self.include, self.skipped) if lo < f[:2] <= hi])

    def read(self, partition):
        yield from _contents(self.root, partition)

    def commit(self, end):
        pass


def files(spark: SparkSession, root: str, include: str = "*.py", skipped: tuple[str, ...] = INDEX_SKIPPED, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Every source file below ``root`` (S1-S6): file_path relative to it,
    content, content_hash, file_size, lines_of_code, is_test_file. ``skipped``
    names the folders to leave out, those of the index by default; ``exclude``
    regular expressions on the relative path. A file over ``MOST_BYTES`` has no
    content."""
    ship(spark)
    spark.dataSource.register(SourceFiles)
    scan = spark.read.format("source_files").option("path", root).option("include", include).option("skipped", ",".join(skipped)).load()
    out = scan.select("file_path", "file_size", F.sha2("content", 256).alias("content_hash"), F.decode("content", "UTF-8").alias("content"))
    for pattern in exclude:
        out = out.where(~F.col("file_path").rlike(pattern))
    name = F.element_at(F.split("file_path", "/"), -1)
    return out.withColumn("lines_of_code", F.size(F.split(F.coalesce("content", F.lit("")), "\n"))).withColumn("is_test_file", name.startswith("test_") | name.endswith("_test.py") | F.col("file_path").rlike("(^|/)tests?/"))


def discovered(spark: SparkSession, root: str, include: tuple[str, ...] = ("*.py",), skipped: tuple[str, ...] = DISCOVERY_SKIPPED, exclude: tuple[str, ...] = DISCOVERY_EXCLUDED) -> DataFrame:
    """Files whose name fits any of the patterns and none of the excluded ones,
    each once, in order (S2)."""
    glob = lambda p: "^" + re.escape(p).replace(r"\*", ".*").replace(r"\?", ".") + "$"
    scan = files(spark, root, "*", skipped)
    name, some = F.substring_index("file_path", "/", -1), F.lit(False)
    for p in include:
        some = some | name.rlike(glob(p))
    for p in exclude:
        some = some & ~name.rlike(glob(p))
    return scan.where(some).dropDuplicates(["file_path"]).orderBy("file_path")


def hashes(files: DataFrame) -> DataFrame:
    """Path and hash of every file."""
    return files.select("file_path", "content_hash")


def changes(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """key and change (added, removed, changed) between two snapshots."""
    a, b = old.select(key, F.col(digest).alias("_a")), new.select(key, F.col(digest).alias("_b"))
    both = a.join(b, key, "full").where(~F.col("_a").eqNullSafe(F.col("_b")))
    return both.select(key, F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").otherwise("changed").alias("change"))


def quick_imports(scan: DataFrame) -> DataFrame:
    """Modules that sources import, by pattern only."""
    names = F.regexp_extract_all("content", F.lit(r"(?m)^\s*(?:from|import)\s+([\w.]+)"), F.lit(1))
    return scan.select("file_path", F.explode(names).alias("module")).distinct()


def call_sites(scan: DataFrame, names: list[str]) -> DataFrame:
    """Lines that call any of the given names."""
    lines = scan.select("file_path", F.posexplode(F.split("content", "\n")).alias("line", "text"))
    called = F.regexp_extract("text", r"\b(" + "|".join(names) + r")\s*\(", 1)
    return lines.withColumn("name", called).where("name != ''").select("file_path", (F.col("line") + 1).alias("line"), "name", F.trim("text").alias("text"))


def catalog(spark: SparkSession) -> DataFrame:
    """Tables and columns that the session knows."""
    rows = [(t.name, c.name, c.dataType) for t in spark.catalog.listTables() for c in spark.catalog.listColumns(t.name)]
    return spark.createDataFrame(rows, "table string, column string, type string")
