"""Cutting lineage in the folder that all executors share."""

from __future__ import annotations

import itertools
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_serial = itertools.count()
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session.

    Only where it is unset and all tasks run in this process (master local), a
    folder of this machine; on a cluster an unset folder is an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="driftwalk-")
        spark.sparkContext.setCheckpointDir(at)
    return at


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, below one folder for each application."""
    return f"{shared_dir(spark)}/driftwalk-{spark.sparkContext.applicationId}/{name}-{next(_serial)}-{uuid.uuid4().hex[:12]}"


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """What is run inside leaves no shuffle files: Spark would else keep them until the driver collects its garbage.

    Only for what is run once: a later run of the same plan would shuffle anew.
    """
    before = spark.conf.get(DROP_SHUFFLES, None)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.unset(DROP_SHUFFLES) if before is None else spark.conf.set(DROP_SHUFFLES, before)


#: Parquet that keeps ids as differences: a column of sorted ids takes next to nothing.
PACKED = {"parquet.writer.version": "v2", "parquet.enable.dictionary": "false", "compression": "zstd"}


def stored(df: DataFrame, name: str, packed: bool = False) -> DataFrame:
    """df written to the shared folder and read again: computed once, safe from lost executors. packed: for columns of ids."""
    at = folder(df.sparkSession, name)
    with shuffles_dropped(df.sparkSession):
        df.write.options(**(PACKED if packed else {})).parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def stored_edges(edges: DataFrame, name: str) -> DataFrame:
    """stored() for edges(src, dst), sorted within tasks: a row takes about a quarter of the bytes."""
    return stored(edges.select("src", "dst").sortWithinPartitions("src", "dst"), name, packed=True)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, whatever file system it is on; none if it isn't there."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(x.getPath().getName() for x in system.listStatus(where)) if system.exists(where) else []


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder, whatever file system it is on."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Deletes all that this application has stored; DataFrames that read it can't be used any more."""
    remove(spark, f"{shared_dir(spark)}/driftwalk-{spark.sparkContext.applicationId}")


def cut(df: DataFrame) -> DataFrame:
    """df, computed once, as packed files: checkpoint() would write its rows as they are, without compression."""
    return stored(df, "cut", packed=True)
