"""Tables written in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_made: dict[str, str] = {}
_local = threading.local()
_kept: list[tuple[str, str]] = []  # application, path


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where that is unset and Spark runs in one process (tests) a temporary
    folder is made; on a cluster its absence is an error.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if sc.applicationId not in _made:
        made = os.path.realpath(tempfile.mkdtemp(prefix="quarrylens-shared-"))
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        _made[sc.applicationId] = "file://" + made
    return _made[sc.applicationId]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_dir(spark)}/quarrylens/{uuid.uuid4().hex}-{name}"


def kept_path(spark: SparkSession, name: str) -> str:
    """A path of its own whose files stay until ``release``."""
    path = fresh_path(spark, name)
    _kept.append((spark.sparkContext.applicationId, path))
    return path


@contextmanager
def scratch(spark: SparkSession):
    """Tables written inside by this thread, but for those written to be kept, are
    deleted at the end: what is returned must not read them."""
    _scopes().append([])
    try:
        yield
    finally:
        for path in _scopes().pop():
            _delete(spark, path)


def _scopes() -> list[list[str]]:
    if not hasattr(_local, "scopes"):
        _local.scopes = []
    return _local.scopes


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Delete the tables that this application has written and kept: for when no
    frame that an operator has returned is to be run any more."""
    mine = [p for app, p in _kept if app == spark.sparkContext.applicationId]
    for path in mine:
        _delete(spark, path)
    _kept[:] = [(app, p) for app, p in _kept if p not in set(mine)]


def written(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage
    ends there, so a lost executor costs no more than the stage at hand. The
    write's own shuffle files are of no more use then, and go."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    if len(_scopes()) > keep:  # a table to be kept belongs to the caller's scratch, if there is one
        _scopes()[-1 - keep].append(path)
    else:
        _kept.append((spark.sparkContext.applicationId, path))
    schema = df.schema
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)
    return spark.read.schema(schema).parquet(path)
