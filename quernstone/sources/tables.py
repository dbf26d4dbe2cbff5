"""Readers for the driver's Parquet tables and for the shared folder of intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


#: Paths of the tables and folders that written() and new_folder() have made and forget() has not deleted.
WRITTEN: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table; the path goes to Spark as it is, whatever the file system."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """The rows of df by hash over four tasks for each core, for work that is long for each row: a small file is read by one task."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *keys)


#: Rows of one task where rows are dealt by their number.
TASK_ROWS = 1_000_000


def dealt_by_rows(df: DataFrame, rows: int, *keys: str, each: int | None = None) -> DataFrame:
    """The rows of df, ``rows`` in number, by hash over as many tasks as they fill with ``each``, one for each core at least: what a task
    sorts or counts does not grow with the table. AQE, which joins tasks by compressed bytes, leaves this number as it is."""
    tasks = -(-rows // (each or TASK_ROWS))
    return df.repartition(max(tasks, df.sparkSession.sparkContext.defaultParallelism), *keys)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Where a local session has none (tests on one machine) a temporary folder is set once; on a cluster
    it would be one machine's own, so there it is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def new_folder(spark: SparkSession) -> str:
    """A path of its own in the shared folder, deleted with the tables that written() makes."""
    path = f"{shared_dir(spark)}/quern-{uuid.uuid4().hex}"
    WRITTEN.append(path)
    return path


#: Spark's setting by which an execution deletes its shuffle files as it ends, not when the driver's heap is next collected.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_end(spark: SparkSession):
    """What runs within leaves no shuffle files: for executions that nobody reads a second time."""
    was = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if was is None else spark.conf.set(CLEANUP, was)


def written(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """The rows of df from a Parquet table in the shared folder.

    Cuts the lineage: a lost executor costs a reread, not a recomputation. The shuffles that made the table end with it, so
    the disk holds those of one step at a time."""
    spark = df.sparkSession
    path = new_folder(spark)
    writer = df.write if partition_by is None else df.write.partitionBy(partition_by)
    with _shuffles_end(spark):
        writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quern_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    if path in WRITTEN:
        WRITTEN.remove(path)


def forget(df: DataFrame | None) -> None:
    """Deletes the table behind a written() frame, once nothing reads it any more."""
    path = getattr(df, "_quern_path", None)
    if path:
        _delete(df.sparkSession, path)


def forget_since(spark: SparkSession, mark: int, but: DataFrame | None = None) -> None:
    """Deletes the tables written after ``mark``, a length of WRITTEN, but for one: what a finished step leaves behind."""
    keep = getattr(but, "_quern_path", None)
    for path in WRITTEN[mark:]:
        if path != keep:
            _delete(spark, path)
