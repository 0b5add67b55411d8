"""Incremental indexing and event windows (R1-R6, 2.14)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import schemas
from ..shipping import ship
from ..sources import code, extract
from ..storage import scratch, written


def source_stream(spark: SparkSession, root: str) -> DataFrame:
    """New and changed source files as they come (R1): path, hash and content."""
    ship(spark)
    spark.dataSource.register(code.SourceFiles)
    stream = spark.readStream.format("source_files").option("path", root).load()
    return stream.select("file_path", F.sha2("content", 256).alias("content_hash"), F.decode("content", "UTF-8").alias("content"))


def _write(files: DataFrame, gone: DataFrame | None, target: str, number: int) -> None:
    """One commit: facts and files of one batch in a folder of its own, so that a
    batch done twice leaves one result (K1). Contents are written once, and both
    are made from that: they are of one version of each file. Files that are gone
    stand without a hash."""
    spark = files.sparkSession
    with scratch(spark):
        held = written(files.dropDuplicates(["file_path"]).select("file_path", "content_hash", "content"), "batch")
        extract.facts(held).write.mode("overwrite").parquet(f"{target}/facts/batch={number}")
        rows = held.select("file_path", "content_hash")
        if gone is not None:
            rows = rows.unionByName(gone.select("file_path", F.lit(None).cast("string").alias("content_hash")))
        rows.write.mode("overwrite").parquet(f"{target}/files/batch={number}")


def index_batch(target: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch step of a stream of files."""
    return lambda batch, number: _write(batch, None, target, number)


def index(spark: SparkSession, root: str, target: str, checkpoint: str) -> StreamingQuery:
    """Index what is new and stop; begun again, it goes on where it was."""
    return source_stream(spark, root).writeStream.foreachBatch(index_batch(target)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _versions(spark: SparkSession, target: str) -> DataFrame:
    """Latest batch and hash of every file ever seen; no hash if it is gone."""
    return spark.read.parquet(f"{target}/files").groupBy("file_path").agg(F.max("batch").alias("batch"), F.max_by("content_hash", "batch").alias("content_hash"))


def update(spark: SparkSession, root: str, target: str, batch_files: int = 100, progress: Callable[[int, int], None] | None = None) -> dict[str, int]:
    """Bring an index up to date by comparing the hashes of all files below
    ``root`` with those it holds (R1): new and changed files are parsed, those that
    are gone leave it, whatever their times. Changes are committed in batches of
    ``batch_files`` files (R2; give more where a commit is dear); ``progress`` is
    told of files done and of all after each. Broken off, it goes on with what is
    not yet committed."""
    scan = code.files(spark, root).select("file_path", "content_hash", "content")
    try:
        known = _versions(spark, target)
    except AnalysisException:  # no index yet
        known = spark.createDataFrame([], "file_path string, batch long, content_hash string")
    first = (known.agg(F.max("batch")).first()[0] or -1) + 1 if not known.isEmpty() else 0
    diff = code.changes(known.where("content_hash IS NOT NULL"), scan, "file_path", "content_hash")
    with scratch(spark):
        diff = written(diff, "changes")
        counts = {r["change"]: r["n"] for r in diff.groupBy("change").agg(F.count("*").alias("n")).collect()}
        fresh = diff.where("change != 'removed'").select("file_path")
        n, batches = fresh.count(), 1
        batches = max(1, -(-n // batch_files))
        gone = diff.where("change = 'removed'")
        if not counts:
            return {}
        place = written(fresh.withColumn("part", F.pmod(F.xxhash64("file_path"), F.lit(batches))), "parts")
        done = 0
        for k in range(batches):
            mine = place.where(F.col("part") == k)
            _write(scan.join(mine.select("file_path"), "file_path", "left_semi"), gone if k == 0 else None, target, first + k)
            done += mine.count()
            if progress is not None:
                progress(done, n)
    return counts


def current(spark: SparkSession, target: str, name: str) -> DataFrame:
    """The latest version of every file's facts: a file's later batch replaces its
    earlier ones, and files that are gone have none (H5: facts belong to a version
    of a file)."""
    latest = _versions(spark, target).where("content_hash IS NOT NULL").select("file_path", "batch")
    rows = spark.read.parquet(f"{target}/facts").where(F.col("table") == name).select("batch", f"{name}.*")
    return rows.join(latest, ["file_path", "batch"], "left_semi").drop("batch").select(*[c.split()[0] for c in schemas.ALL[name].split(", ")])


def affected(members: DataFrame, changed: DataFrame, category: str, key: str) -> DataFrame:
    """Members of the categories that a change touches, to be clustered anew."""
    touched = members.join(changed.select(key).distinct(), key, "left_semi").select(category).distinct()
    return members.join(touched, category, "left_semi")


def event_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Counts by window and type over a stream or a table, late rows dropped."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    out = timed.groupBy(F.window("ts", width, slide).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each user."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    out = timed.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def deduplicated(events: DataFrame, key: str = "event_id", late: str = "10 minutes") -> DataFrame:
    """Each event once, within the watermark."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark([key])
