"""Tables written to the folder that all executors share, so that lost executors cost no recomputation."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """A folder of this application under ``spark.checkpoint.dir``.

    Where the setting is missing a temporary folder is used, in local mode only: on a cluster
    the driver's disk is not visible to the executors, so the missing setting is an error.
    """
    context = spark.sparkContext
    app = context.applicationId
    if app not in _FOLDERS:
        base = context.getConf().get("spark.checkpoint.dir")
        if not base:
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="sonaria-")
        _FOLDERS[app] = f"{base.rstrip('/')}/sonaria-{app}"
        atexit.register(delete_path, spark, _FOLDERS[app])
    return _FOLDERS[app]


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def file_system(spark: SparkSession, path: str):
    """The file system and the path as the JVM knows them."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a table that is no longer needed; a stopped session leaves it to the cluster."""
    if spark.sparkContext._jsc is None or spark.sparkContext._jvm is None:
        return
    try:
        store, target = file_system(spark, path)
        store.delete(target, True)
    except Exception:  # the session is ending; the shared folder has its own retention
        return


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
