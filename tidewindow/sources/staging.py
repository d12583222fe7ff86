"""Cutting lineage with a written table in the folder the cluster names.

A written table lives until the application ends, since a returned plan may still read it; then
the file system that holds it removes it.
"""

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame


def stage_root(spark) -> str:
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    root = tempfile.mkdtemp(prefix="spark-")
    atexit.register(shutil.rmtree, root, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def remove_at_exit(spark, path: str) -> None:
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)


def stage(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write once, read back: several consumers then share one computation.

    The table outlives any executor, unlike a cache, and keeps column pruning and pushdown.
    """
    spark = df.sparkSession
    path = f"{stage_root(spark)}/stage-{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    remove_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)
