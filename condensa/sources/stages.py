"""Tables written between the steps of an iterative plan, in the folder that the whole cluster shares."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or the context's checkpoint folder; a session in one process may use its own warehouse."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found and spark.sparkContext.master.split("[")[0] == "local":
        found = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/condensa-work"
    if not found:
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return found.rstrip("/")


class Stages:
    """Written tables of one run: each cuts the lineage, so a lost executor costs one step. ``close`` deletes all but the last."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder, self.paths = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}", []

    def write(self, df: DataFrame) -> DataFrame:
        self.paths.append(f"{self.folder}/{len(self.paths)}")
        df.write.parquet(self.paths[-1])
        return self.spark.read.schema(df.schema).parquet(self.paths[-1])

    def close(self, df: DataFrame) -> DataFrame:
        """``df`` as the last table; the others are deleted."""
        out = self.write(df)
        for path in self.paths[:-1]:
            remove(self.spark, path)
        return out


def once(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table ``make()`` under this name: written by the first call in an application, only read by later ones."""
    digest = hashlib.sha1(f"{spark.sparkContext.applicationId}|{name}".encode()).hexdigest()
    path = f"{shared_folder(spark)}/once-{digest}"
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of any file system that Spark reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
