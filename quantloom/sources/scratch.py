"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; on one machine (a local master, as in tests) a folder is made where the session names none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if "cluster" in master or not master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    return _made(spark.sparkContext.applicationId)


@lru_cache(maxsize=8)
def _made(application: str) -> str:
    return tempfile.mkdtemp(prefix=f"quantloom-{application}-")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written there below the application's id and read back: for what is read several times, and to cut its lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
