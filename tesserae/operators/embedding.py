"""Sine and cosine position embedding of a token grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def positions(spark: SparkSession, height: int, width: int, channels: int) -> DataFrame:
    """c, y, x, value: quarters of the channels hold sin y, cos y, sin x, cos x at falling frequencies."""
    if channels % 4:
        raise ValueError("channels must be a multiple of 4")
    q = channels // 4
    d = spark.range(channels).select(F.col("id").alias("c"))
    d = d.withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(height - 1)))).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    omega = F.pow(F.lit(10000.0), -(F.col("c") % q) / F.lit(float(q)))
    angle = F.when(F.col("c") < 2 * q, F.col("y")).otherwise(F.col("x")) * omega
    return d.select("c", F.col("y").cast("bigint").alias("y"), F.col("x").cast("bigint").alias("x"), F.when(F.floor(F.col("c") / q) % 2 == 0, F.sin(angle)).otherwise(F.cos(angle)).alias("value"))
