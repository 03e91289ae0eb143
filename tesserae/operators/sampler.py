"""Batch plans: single-bucket batches in a seeded order, rank shards, resume, accumulation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import hash_number, permutation_keys, permute, rectangle
from .ordering import group_places


def index(items: DataFrame, key: str = "image_id", bucket: str = "bucket_id") -> DataFrame:
    """key, bucket, place (gapless in the bucket, from 0), n (the bucket's size): what plans of all epochs are made of. Worth storing."""
    return group_places(items.select(key, bucket), [bucket], hash_number("index", F.col(key)), key)


def planned(indexed: DataFrame, batch_size: int, seed: int = 42, epoch: int = 0, drop_last: bool = True, key: str = "image_id", bucket: str = "bucket_id", total: bool = False) -> DataFrame:
    """batch_no, bucket, pos, key (and batches, how many there are, where ``total``) of an ``index``: each bucket's places permuted and cut into batches, and all batches permuted, by keys of (seed, epoch).

    Each row's batch follows from its place, so an epoch's plan shuffles only a row a bucket; the same for the same
    (seed, epoch, items), whatever the partitioning.
    """
    full = F.floor if drop_last else F.ceil
    b = indexed.groupBy(bucket).agg(F.first("n").alias("__n")).withColumn("__b", full(F.col("__n") / batch_size))
    # buckets are few: a row each
    b = b.withColumns({"__first": F.sum("__b").over(Window.orderBy(bucket)) - F.col("__b"), "__all": F.sum("__b").over(Window.partitionBy(F.lit(0)))})
    (x, y), (x2, y2) = rectangle(F.col("__n")), rectangle(F.col("__all"))
    b = b.withColumns({"__x": x, "__y": y, "__x2": x2, "__y2": y2, "__keys": permutation_keys(seed, epoch, F.col(bucket)), "__keys2": permutation_keys(seed, epoch, "batch")})
    d = permute(indexed.drop("n").join(F.broadcast(b), bucket), "place", "__n", "__x", "__y", "__keys", "__to")
    local = F.floor(F.col("__to") / batch_size)
    d = d.where(local < F.col("__b")).withColumn("__no", F.col("__first") + local)
    d = permute(d, "__no", "__all", "__x2", "__y2", "__keys2", "batch_no")
    return d.select("batch_no", bucket, (F.col("__to") % batch_size).alias("pos"), key, *([F.col("__all").alias("batches")] if total else []))


def plan(items: DataFrame, batch_size: int, seed: int = 42, epoch: int = 0, drop_last: bool = True, key: str = "image_id", bucket: str = "bucket_id", total: bool = False) -> DataFrame:
    """batch_no, bucket, pos, key: single-bucket batches of all items in a seeded order. For several epochs, store the ``index`` and use ``planned``."""
    return planned(index(items, key, bucket), batch_size, seed, epoch, drop_last, key, bucket, total)


def shard(plan: DataFrame, world: int) -> DataFrame:
    """Adds rank and local_no; ranks get equally many batches, the rest is dropped. A plan without ``batches`` is read twice."""
    if "batches" not in plan.columns:
        plan = plan.withColumn("batches", plan.agg(F.max("batch_no") + 1).scalar())
    d = plan.where(F.floor(F.col("batch_no") / world) < F.floor(F.col("batches") / world)).drop("batches")
    return d.withColumns({"rank": (F.col("batch_no") % world).cast("bigint"), "local_no": F.floor(F.col("batch_no") / world)})


def load(plan: DataFrame, catalog: DataFrame, key: str = "image_id") -> DataFrame:
    """The catalog's rows in plan order: a batch lies whole in one partition, ready for Arrow batches."""
    n = int(plan.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = plan.join(catalog.drop(*(c for c in plan.columns if c != key)), key)
    return rows.repartitionByRange(n, "batch_no").sortWithinPartitions("batch_no", "pos")


def resume(sharded: DataFrame, rank: int, offset: int) -> DataFrame:
    """The rank's batches from its own offset on."""
    return sharded.where((F.col("rank") == rank) & (F.col("local_no") >= offset))


def accumulate(sharded: DataFrame, accumulation: int, bucket: str = "bucket_id") -> DataFrame:
    """Per rank and full window of batches: sizes, and the step within the epoch."""
    w = sharded.withColumn("window_no", F.floor(F.col("local_no") / accumulation))
    return (
        w.groupBy("rank", "window_no")
        .agg(F.count_distinct("local_no").alias("n_batches"), F.count("*").alias("n_images"), F.count_distinct(bucket).alias("n_buckets"))
        .where(F.col("n_batches") == accumulation)
        .withColumn("step_in_epoch", F.col("window_no") + 1)
    )


def first_per_bucket(items: DataFrame, batches: int, batch_size: int, key: str = "image_id", bucket: str = "bucket_id") -> DataFrame:
    """The first batches of each bucket in key order; the limit works before the shuffle."""
    if batches < 1:
        raise ValueError("at least one batch a bucket is needed")
    rn = F.row_number().over(Window.partitionBy(bucket).orderBy(key))
    return items.withColumn("rn", rn).where(F.col("rn") <= batches * batch_size).withColumn("batch_idx", F.floor((F.col("rn") - 1) / batch_size)).drop("rn")
