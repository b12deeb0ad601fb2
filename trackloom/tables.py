"""Tables that cut lineage: written to the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; where the session names none, below the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return f"{root.rstrip('/')}/trackloom-{uuid.uuid4().hex}"


def written(frame: DataFrame) -> DataFrame:
    """The frame as a Parquet table in the shared folder; survives lost executors. Packed tightly, as such
    tables are read once or twice and the folder is shared."""
    path = scratch_dir(frame.sparkSession)
    frame.write.parquet(path, compression="zstd")
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
