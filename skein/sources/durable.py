"""Cutting lineage in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, or the context's; where neither is set, a new local one, if the driver runs the executors too."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/") if folder else own_folder(spark.sparkContext.master, spark.sparkContext.applicationId)


@lru_cache(maxsize=8)
def own_folder(master: str, application: str) -> str:
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
    return "file://" + tempfile.mkdtemp(prefix="skein-")


@lru_cache(maxsize=8)
def of_application(spark: SparkSession, folder: str) -> str:
    """A folder in it for this application, which goes when the driver ends in good order."""
    path = f"{folder}/skein-{spark.sparkContext.applicationId}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(at)
    files.deleteOnExit(at)
    return path


#: Whether the shuffle files of a query go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def tidy_shuffles(spark: SparkSession) -> Iterator[None]:
    """Inside, a query's shuffle files go with its end, not when the driver happens to collect its garbage."""
    if not spark.conf.isModifiable(CLEANUP):  # another version
        yield
        return
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again, without lineage and with true sizes."""
    spark = df.sparkSession
    path = f"{of_application(spark, shared_folder(spark))}/{name}-{uuid.uuid4().hex}"
    with tidy_shuffles(spark):
        df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete what ``written`` wrote and ``df`` reads; nothing may read it again. Other folders stay."""
    spark = df.sparkSession
    own = of_application(spark, shared_folder(spark))
    at = spark._jvm.org.apache.hadoop.fs.Path
    files = at(own).getFileSystem(spark._jsc.hadoopConfiguration())
    own = files.makeQualified(at(own))
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if at(folder).getParent().toUri().getPath() == own.toUri().getPath():
            files.delete(at(folder), True)
