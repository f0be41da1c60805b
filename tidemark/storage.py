"""Tables that cut lineage: written once to the cluster's shared checkpoint folder, read back as Parquet."""

from __future__ import annotations

import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a temporary one only where none is named (tests, local mode)."""
    root = spark.conf.get("spark.checkpoint.dir", "")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def materialize(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write df to a fresh table in the shared folder and return a scan of it.

    Unlike a cached or locally checkpointed frame, the table outlives any executor.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sweep(spark: SparkSession, hours: float = 24) -> int:
    """Delete the written tables that are older than some hours, longer than any query runs; how many there were."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    base = hadoop.Path(f"{scratch_dir(spark)}/tidemark")
    files = base.getFileSystem(spark._jsc.hadoopConfiguration())
    old = [s.getPath() for s in (files.listStatus(base) if files.exists(base) else ()) if s.getModificationTime() < (time.time() - hours * 3600) * 1000]
    for path in old:
        files.delete(path, True)
    return len(old)
