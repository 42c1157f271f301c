"""Reading the driver's tables, and folders for what one step hands to several others."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, least: int = 1 << 20, most: int = 1 << 29) -> DataFrame:
    """Deal a small table that lies in few row groups out to all cores, before heavy work on each row.

    Tables of half a gigabyte and more have row groups enough and stay as they are."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    cores = df.sparkSession.sparkContext.defaultParallelism
    if least <= size < most and df.rdd.getNumPartitions() < 2 * cores:
        return df.repartition(cores)
    return df


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as a URI; a temporary one only where none is named and all runs on one machine."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if not named and sc._jsc.sc().getCheckpointDir().isDefined():
        named = sc._jsc.sc().getCheckpointDir().get()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="tamis-")
        sc.setCheckpointDir(named)
    # A path without a scheme lies in the cluster's default file system, not on this machine.
    path = sc._jvm.org.apache.hadoop.fs.Path(named)
    return path.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """URI of a fresh folder below the shared one."""
    return f"{shared_folder(spark)}/tamis/{name}-{uuid.uuid4().hex[:12]}"


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table of the shared folder: computed once, whoever reads it."""
    uri = scratch(spark, name)
    df.write.parquet(uri)
    return spark.read.schema(df.schema).parquet(uri)
