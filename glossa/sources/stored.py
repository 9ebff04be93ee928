"""Tables that later steps read again, in the folder that all tasks share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see (`spark.checkpoint.dir`); a temporary one where all tasks run in the driver's process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="glossa-stored-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def stored(df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    """`df` as a written table, in folders by the columns `by`; what reads it starts from files, so what made it runs once and lost executors cost their own tasks."""
    path = f"{shared_folder(df.sparkSession)}/glossa/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by or []).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
