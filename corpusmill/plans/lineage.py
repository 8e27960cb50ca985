"""Cutting lineage with tables written to the cluster's shared folder.

Iterative operators reread a written table in place of recomputing it; the files survive the loss
of an executor, which a local checkpoint doesn't.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. A session that names none gets one of our own if it runs on this
    machine only; on a cluster it is refused, as executors couldn't read what the driver writes."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="corpusmill-"))
    return spark.sparkContext.getCheckpointDir()


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark).rstrip('/')}/corpusmill-{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str = "step") -> DataFrame:
    """`df` as a parquet table in the shared folder, read back; its plan starts at that scan."""
    spark = df.sparkSession
    path = f"{_own_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession) -> None:
    """Deletes the tables this application has written. To be called once results are stored or read, as results
    are still read from them."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
