"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """A folder of this application in ``spark.checkpoint.dir``, removed when Python ends.

    Where that is unset and all runs on one machine, a temporary folder stands in; on a cluster that is an error.
    """
    app = spark.sparkContext.applicationId
    if app not in _folders:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            base = tempfile.mkdtemp(prefix="brindle-")
        _folders[app] = f"{base.rstrip('/')}/tables-{app}"
        atexit.register(remove, spark, _folders[app])
    return _folders[app]


def new_path(spark: SparkSession, name: str = "t") -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def file_system(spark: SparkSession, path: str):
    """(Hadoop's file system of ``path``, its path class)."""
    kind = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return kind(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), kind


def remove(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:
        fs, kind = file_system(spark, path)
        fs.delete(kind(path), True)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: cuts the lineage by files that a lost executor can't take along."""
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes written tables that no later step reads, and lets Spark drop the shuffle files of finished steps now instead of at some later collection."""
    for df in tables:
        for file in df.inputFiles()[:1]:
            remove(df.sparkSession, file.rsplit("/", 1)[0])
    gc.collect()
    tables[0].sparkSession.sparkContext._jvm.System.gc()
