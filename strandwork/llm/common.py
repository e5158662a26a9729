"""Shared pieces: tables in the cluster's shared folder, reading, names, memories, and connected components."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..operators.components import connected_components  # noqa: F401

ARROW_ROWS = 2000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a folder of our own in local mode where it is unset."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="strandwork-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _delete_at_exit(spark: SparkSession, path: str) -> None:
    try:
        if spark.sparkContext._jsc is not None:
            delete_path(spark, path)
    except Exception:  # the JVM may be gone already
        pass


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_delete_at_exit, spark, path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: lineage is cut and a lost executor loses nothing."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def drop_stored(df: DataFrame) -> None:
    """Delete a table made by stored() that no later plan reads."""
    delete_path(df.sparkSession, df._stored_at)


def arrow_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Bound what a Python worker holds at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def fresh(taken: list[str], name: str) -> str:
    """name, or with underscores after it until no column of `taken` has it (in any case, as Spark compares names)."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


class Recent:
    """What a task has worked out lately: at most about twice `size` entries, those in use kept; made in a task and gone with it."""

    def __init__(self, size: int):
        self.size, self.now, self.before = size, {}, {}

    def unknown(self, keys) -> list:
        """Keys not held; those held from before come along."""
        if len(self.now) > self.size:
            self.now, self.before = {}, self.now
        now, before, out = self.now, self.before, []
        for k in keys:
            if k not in now:
                if k in before:
                    now[k] = before[k]
                else:
                    out.append(k)
        return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
