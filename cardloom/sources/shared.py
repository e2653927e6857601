"""Where tables that a job writes and reads again may lie."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the folder of spark.checkpoint.dir (or the context's checkpoint folder), which driver and executors share. A local
    session without one gets a temporary folder of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    root = root or (held.get() if held.isDefined() else None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, old: DataFrame | None = None) -> DataFrame:
    """df written below the shared folder and read again, so that it is worked out once; then the files of `old`, a table that this function
    returned and that df was made from, are deleted."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, name)
    df.write.parquet(path)
    if old is not None:
        gone = spark._jvm.org.apache.hadoop.fs.Path(old.inputFiles()[0]).getParent() if old.inputFiles() else None
        gone and gone.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(gone, True)
    return spark.read.schema(df.schema).parquet(path)
