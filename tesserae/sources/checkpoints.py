"""Checkpoint manifests: a file of one row for each checkpoint. Tensor files are outside the engine."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.telemetry import resume_point
from .config import Config, schema

SCHEMA = "step bigint, epoch bigint, batch_offset bigint, path string, config_json string"


def append(spark: SparkSession, manifest: str, step: int, epoch: int, batch_offset: int, path: str, config: Config) -> None:
    """Adds a row: written in a folder that readers skip, and then renamed, so a reader sees all of it or nothing."""
    name = uuid.uuid4().hex
    made = f"{manifest.rstrip('/')}/_{name}"
    spark.createDataFrame([(step, epoch, batch_offset, path, json.dumps(config.tree()))], SCHEMA).coalesce(1).write.parquet(made)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(made)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    part = next(f.getPath() for f in fs.listStatus(at) if f.getPath().getName().startswith("part-"))
    if not fs.rename(part, jvm.org.apache.hadoop.fs.Path(f"{manifest.rstrip('/')}/checkpoint-{step}-{name}.parquet")):
        raise OSError(f"{part} can't be renamed")
    fs.delete(at, True)


def read(spark: SparkSession, manifest: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(manifest)


def with_config(rows: DataFrame) -> DataFrame:
    """Adds the configuration of each checkpoint as a struct; keys that it doesn't know are left out, missing ones null."""
    return rows.withColumn("config", F.from_json("config_json", schema()))


def find_resume(spark: SparkSession, manifest: str, step: int | None = None, fresh: bool = False):
    """The row to resume from (a given step, else the latest), or None on a fresh start."""
    return None if fresh else resume_point(read(spark, manifest), step).first()
