"""The folder that the driver and all executors share, and what is kept in it."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where unset, the context's checkpoint folder, or a local one if all runs in one process.

    On a cluster a local folder would be read by machines that don't have it, so that raises.
    """
    sc = spark.sparkContext
    there = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not there:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        there = tempfile.mkdtemp(prefix="tesserae-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(there)
    return there


def fresh_path(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage at reliable storage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _at(spark: SparkSession, path: str):
    """The file system of a path, and the path, as Hadoop's."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p)


def names(spark: SparkSession, path: str) -> list[str]:
    """What is in a folder; nothing, if there is none."""
    fs, p = _at(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(p)) if fs.exists(p) else []


def age(spark: SparkSession, path: str) -> float:
    """When a file or folder was last modified, in seconds."""
    fs, p = _at(spark, path)
    return fs.getFileStatus(p).getModificationTime() / 1000


def create(spark: SparkSession, path: str, data: bytes) -> None:
    """A small file with its folders; one that is there is replaced."""
    fs, p = _at(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def move(spark: SparkSession, made: str, to: str) -> bool:
    """Renames a folder; False, and nothing moved, if the target is there."""
    fs, p = _at(spark, made)
    _, q = _at(spark, to)
    if fs.exists(q):
        return False
    if not fs.rename(p, q):
        raise OSError(f"{made} can't be renamed to {to}")
    return True


def delete(spark: SparkSession, path: str) -> None:
    """Removes a folder of the shared store, with what is in it."""
    fs, p = _at(spark, path)
    fs.delete(p, True)
