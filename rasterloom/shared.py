"""The folder that all executors share, for checkpoints and written tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession, what: str = "work") -> str:
    """A new path below spark.checkpoint.dir; only where that is unset on one machine (tests) a temporary folder is made and set."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir isn't set: executors of a cluster need a folder that all of them share")
        root = "file://" + tempfile.mkdtemp(prefix="checkpoint-")
        sc.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, at: str) -> None:
    """Delete a folder that ``shared_dir`` named, once nothing reads it any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def settle(df: DataFrame) -> DataFrame:
    """``df`` by way of a reliable checkpoint: its lineage ends at files in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
