"""Cutting lineage through storage that every executor can reach.

The folder is the one the session names in ``spark.checkpoint.dir``.  Only a session that names none
(tests, a laptop) gets a private temporary folder; on a cluster such a folder would not be shared.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_DIR_KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session; it is set where it is unset and the master is local."""
    folder = spark.conf.get(_DIR_KEY, None) or spark.sparkContext.getConf().get(_DIR_KEY)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError(f"{_DIR_KEY} must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="auditloom-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder; removed when the driver ends."""
    path = f"{shared_dir(spark)}/auditloom/{label}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder made by ``new_folder``; a session that has ended leaves nothing to call."""
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001 - at interpreter exit the gateway may be gone already
        return


def stage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lost executors lose no work."""
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Ask the driver to collect plans that nothing refers to any more: with them go their shuffle files, which a long loop
    otherwise keeps until the driver's memory is full."""
    spark.sparkContext._jvm.System.gc()


class Stages:
    """Staged tables of one computation, so that a superseded one is dropped early."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._paths: dict[int, str] = {}

    def put(self, df: DataFrame, label: str) -> DataFrame:
        path = new_folder(self.spark, label)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = path
        return out

    def drop(self, df: DataFrame) -> None:
        path = self._paths.pop(id(df), None)
        if path:
            remove(self.spark, path)
