"""Tables written between the steps of an iterative operator, in the folder that the cluster shares."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a temporary folder only where it is unset and nothing runs elsewhere."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = os.path.join(tempfile.gettempdir(), f"fingerloom-{os.getpid()}")
    os.makedirs(own, exist_ok=True)
    return f"file://{own}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write df and read it back: lineage ends here and lost executors cost one stage, not the whole plan."""
    path = f"{shared_folder(df.sparkSession)}/fingerloom/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
