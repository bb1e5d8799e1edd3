"""Tables written to the folder that all executors share: they cut the plan, and survive lost executors."""

from __future__ import annotations

import re
import tempfile
import uuid

import pyarrow.fs as stores
from pyspark.sql import DataFrame, SparkSession


def store(folder: str) -> tuple[stores.FileSystem, str]:
    """The file system of a folder (local, hdfs, s3) and the path in it, for tasks that write or read files which Spark has no source for."""
    fs, path = stores.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", re.sub("^file:/(?!//)", "file:///", folder)))
    return fs, path.rstrip("/")


def file_system(spark: SparkSession, path: str):
    """Spark's own path and file system, for the driver."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def shared_folder(spark: SparkSession) -> str:
    """What `spark.checkpoint.dir` names. Where it is unset a local session, whose tasks are all on this machine, gets one of its own."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="weftline-")
        sc.setCheckpointDir(named)
        named = sc.getCheckpointDir()
    return named.rstrip("/")


class Scratch:
    """Tables of one run of an operator; what is not dropped before goes when the session's JVM ends."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/weftline-{uuid.uuid4().hex}"
        self.n = 0

    def path(self, name: str) -> str:
        if not self.n:
            root, fs = file_system(self.spark, self.root)
            fs.mkdirs(root)
            fs.deleteOnExit(root)
        self.n += 1
        return f"{self.root}/{self.n:03d}-{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.mode("overwrite").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that no later plan reads."""
        for t in tables:
            self.forget(t.scratch_path)

    def forget(self, path: str) -> None:
        p, fs = file_system(self.spark, path)
        fs.delete(p, True)
