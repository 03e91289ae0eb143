"""Stand-in tables over the driver's data, which has no images: deterministic columns of other tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import row_numbers


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, width, height, from orders."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select(
        F.col("o_orderkey").cast("bigint").alias("image_id"), (320 + (F.col("o_custkey") * 7919) % 3841).cast("int").alias("width"), (240 + (F.col("o_orderkey") * 104729) % 2161).cast("int").alias("height")
    )


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, path, from document ids: nested folders, suffixes of any case, some of no image."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    i = F.col("doc_id")
    suffix = F.element_at(F.array(*map(F.lit, (".jpg", ".JPEG", ".png", ".Webp", ".bmp", ".txt", ".jpg.gz"))), (i % 7 + 1).cast("int"))
    folder = F.element_at(F.array(*map(F.lit, ("a", "a-b", "a/b", "Z"))), (i % 4 + 1).cast("int"))
    return d.select(i.cast("bigint").alias("image_id"), F.concat(F.lit("img/"), folder, F.lit("/f"), i.cast("string"), suffix).alias("path"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label, z (64 doubles)."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), F.col("embedding").cast("array<double>").alias("z"))


def codebook(spark: SparkSession, sf_dir: str, size: int = 32) -> DataFrame:
    """code, e: the first vectors."""
    return vectors(spark, sf_dir).where(F.col("vec_id") < size).select(F.col("vec_id").alias("code"), F.col("z").alias("e"))


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """step (from 1, by time), bucket, seconds, from events."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", "event_id", F.col("event_type").alias("bucket"), F.col("value").cast("double").alias("seconds"))
    return row_numbers(e, "ts", "event_id", out="step").select("step", "bucket", "seconds")


def checkpoints(spark: SparkSession, sf_dir: str, every: int = 250, per_epoch: int = 3000, accumulation: int = 8) -> DataFrame:
    """step, epoch, batch_offset at a fixed cadence over the telemetry steps."""
    n = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    s = F.col("step")
    return spark.range(every, n + 1, every).select(F.col("id").alias("step")).select("step", F.floor(s / per_epoch).alias("epoch"), (s % per_epoch * accumulation).alias("batch_offset"))
