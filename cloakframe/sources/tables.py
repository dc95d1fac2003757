"""Tables that cut a long plan: written to the folder that a cluster shares, and read again."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


@lru_cache(maxsize=8)
def _removed_at_exit(base: str) -> None:
    spark = SparkSession.getActiveSession()
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)


def shared_path(spark: SparkSession) -> str:
    """A new path under spark.checkpoint.dir, in a folder that goes with the application.

    Where that setting is unset, a temporary folder serves on one machine (local[...]); on a cluster it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="cloakframe-")
        spark.conf.set("spark.checkpoint.dir", base)
    own = f"{base.rstrip('/')}/cloakframe/{spark.sparkContext.applicationId}"
    _removed_at_exit(own)
    return f"{own}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The same rows from a Parquet table in the shared folder, which outlives lost executors."""
    path = shared_path(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
