"""Where queries that test readers and writers put their files."""

import tempfile
import uuid

from pyspark.sql import SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder, on a local session without one a temporary one."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if shared is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return f"{shared or tempfile.mkdtemp(prefix='turnwise-')}/{name}-{uuid.uuid4().hex}"
