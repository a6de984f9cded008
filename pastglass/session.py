"""A session with the settings that the engine's plans are made for."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Settings for large inputs; those of a local session are given to local().
CLUSTER = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
}


def local(cores: int = 8, memory: str = "8g") -> SparkSession:
    """A session on this machine, one shuffle partition for each core."""
    builder = SparkSession.builder.master(f"local[{cores}]").config("spark.driver.memory", memory).config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", str(cores))
    return builder.config(map=CLUSTER).getOrCreate()
