"""Durable work tables in the folder that the cluster shares."""

from __future__ import annotations

import gc
import re
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where a local session names no shared folder, as in tests.
LOCAL_DEFAULT = "file:///tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """URI of the folder that the driver and every executor can reach; a cluster must name it in spark.checkpoint.dir."""
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    configured = configured or spark.conf.get("spark.checkpoint.dir", "")
    if not configured and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (configured or LOCAL_DEFAULT).rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh folder URI for one run, so that reruns never meet old files."""
    return f"{shared_dir(spark)}/ledgerline/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage: a lost executor costs a re-read, never a recomputation
    of what stands above.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.work_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete work tables that ``staged`` wrote, once what depends on them is itself written."""
    for df in tables:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(df.work_path)
        path.getFileSystem(conf).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of datasets that nobody holds any more.

    Its cleaner acts only when the driver's JVM collects garbage, which may be long after a
    phase has been written and read back.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
