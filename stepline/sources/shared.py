"""The folder that the driver and all executors see, and what is written there between steps."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``.

    Where that is unset, a temporary folder is made and set if the master is local; on a cluster,
    whose executors would not see it, this raises.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors see")
        where = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(where)
    return where


def cut(df: DataFrame) -> DataFrame:
    """The rows of ``df`` as written to the shared folder: what follows neither repeats nor loses them."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt evenly to a few tasks for each core.

    For rows that cost far more time than their bytes tell: files are split by bytes, and few splits would do all the work.
    """
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{os.urandom(8).hex()}"
