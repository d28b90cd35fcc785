"""Session helpers: the shared folder for checkpoints and intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local-mode session that names none gets a temporary folder; a
    cluster session without the setting is an error.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
        return named
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="cohortlake-"))
    return sc.getCheckpointDir()


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder, never reused."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path for it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def file_exists(spark: SparkSession, path: str) -> bool:
    fs, at = file_system(spark, path)
    return fs.exists(at)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a file or folder, if it is there."""
    fs, at = file_system(spark, path)
    fs.delete(at, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: later stages read files, so a lost executor cannot change the rows."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def materialised(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: a short lineage for data that several later steps read."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# what reading a file counts for besides its bytes; Spark's own 4 MB leaves a task 32 files
OPEN_COST = "64k"


@contextmanager
def small_files(spark: SparkSession) -> Iterator[None]:
    """File scans that are planned inside put many small files into a task.

    A task gets files up to ``spark.sql.files.maxPartitionBytes``; large files are dealt as before, as their own bytes count.
    """
    name = "spark.sql.files.openCostInBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, OPEN_COST)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def stacked(*frames: DataFrame) -> DataFrame:
    """Union by name of inputs that later steps join again.

    Spark 4.1 lets a union pass on the partitioning of its inputs; when adaptive execution has
    coalesced those differently, a join above it fails to plan.  That option is switched off.
    """
    frames[0].sparkSession.conf.set("spark.sql.unionOutputPartitioning", "false")
    return reduce(DataFrame.unionByName, frames)
