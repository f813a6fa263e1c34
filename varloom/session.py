"""Runtime SQL settings the operators are planned for."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Adaptive execution with skew handling, no generated method that the JVM
# would refuse to compile (HotSpot leaves methods over 8000 bytes interpreted), and Arrow
# batches that stay small when rows are whole texts. Plan descriptions, which the driver keeps
# for every query, are cut short: constants of a plan can be large.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.maxPlanStringLength": "20000",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the settings; each can be changed at run time, none needs a restart."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark
