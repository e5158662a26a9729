"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of our own in local mode where it is unset."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="strandwork-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def delete_path(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _delete_at_exit(spark: SparkSession, path: str) -> None:
    try:
        if spark.sparkContext._jsc is not None:
            delete_path(spark, path)
    except Exception:  # the JVM may be gone already
        pass


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder, deleted when the driver's Python ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_delete_at_exit, spark, path)
    return path


#: Has Spark delete a query's shuffles as it ends, not when the driver's garbage is next collected.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_scopes = threading.local()


def _open() -> list:
    if not hasattr(_scopes, "open"):
        _scopes.open = []
    return _scopes.open


@contextmanager
def passing():
    """Tables that saved() writes within are deleted at the end, but for those given to the function that it yields; these pass to the scope around."""
    mine, kept = [], set()
    _open().append(mine)

    def keep(*tables: DataFrame):
        kept.update(df._saved_at for df in tables)
        return tables if len(tables) != 1 else tables[0]

    try:
        yield keep
    finally:
        _open().pop()
        around = _open()[-1] if _open() else None
        for df in mine:
            if df._saved_at not in kept:
                drop(df)
            elif around is not None:
                around.append(df)


@contextmanager
def lasting():
    """Tables that saved() writes within stay, whatever scope is around."""
    _open().append(None)
    try:
        yield
    finally:
        _open().pop()


def saved(df: DataFrame, name: str) -> DataFrame:
    """A written table: lineage is cut, and a lost executor loses nothing. The shuffles behind it are deleted."""
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_at = path
    if _open() and _open()[-1] is not None:
        _open()[-1].append(out)
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables made by saved() that no later plan reads."""
    for df in tables:
        delete_path(df.sparkSession, df._saved_at)
