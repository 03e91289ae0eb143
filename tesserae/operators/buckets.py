"""Aspect-ratio buckets: table, geometry, nearest-bucket assignment, counts, steps."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CELL = 32

# The default bucket table (name, width, height), in tie order.
DEFAULT = (
    ("1:1", 768, 768),
    ("4:5", 608, 768),
    ("5:4", 768, 608),
    ("4:3", 768, 576),
    ("3:4", 576, 768),
    ("3:2", 768, 512),
    ("2:3", 512, 768),
    ("16:9", 768, 448),
    ("9:16", 448, 768),
)


@dataclass(frozen=True)
class Bucket:
    name: str
    width: int
    height: int

    def __post_init__(self):
        if self.width <= 0 or self.height <= 0 or self.width % CELL or self.height % CELL:
            raise ValueError(f"bucket {self.name}: sides must be positive multiples of {CELL}")


DEFAULT_BUCKETS = tuple(Bucket(*b) for b in DEFAULT)


def table(spark: SparkSession, buckets=DEFAULT_BUCKETS) -> DataFrame:
    """bucket_id, bucket, bw, bh."""
    return spark.createDataFrame([(i, b.name, b.width, b.height) for i, b in enumerate(buckets)], "bucket_id int, bucket string, bw int, bh int")


def geometry(buckets: DataFrame) -> DataFrame:
    """Ratio, token grid (height first) and token count; a side that isn't a multiple of 32 raises."""
    sound = F.assert_true((F.col("bw") % CELL == 0) & (F.col("bh") % CELL == 0), F.lit("bucket sides must be multiples of 32"))
    gh, gw = F.floor(F.col("bh") / CELL), F.floor(F.col("bw") / CELL)
    return buckets.where(sound.isNull()).select("bucket_id", "bucket", "bw", "bh", (F.col("bw") / F.col("bh")).alias("aspect_ratio"), gh.alias("grid_h"), gw.alias("grid_w"), (gh * gw).alias("num_tokens"))


def nearest(width: Column, height: Column, buckets=DEFAULT_BUCKETS) -> Column:
    """Struct d, bucket_id of the bucket with the nearest log ratio; of equal ones the first. One expression, no join."""
    target = F.ln(width / height)
    return F.least(*(F.struct(F.abs(F.lit(math.log(b.width / b.height)) - target).alias("d"), F.lit(i).alias("bucket_id")) for i, b in enumerate(buckets)))


def sound(images: DataFrame) -> DataFrame:
    """Images whose sides can have a ratio."""
    return images.where((F.col("width") > 0) & (F.col("height") > 0))


def assign(images: DataFrame, buckets=DEFAULT_BUCKETS) -> DataFrame:
    """Adds bucket_id, bucket, bw, bh. Images need positive sides."""
    pick = lambda f: F.element_at(F.array(*(F.lit(f(b)) for b in buckets)), F.col("bucket_id") + 1)
    d = sound(images).withColumn("bucket_id", nearest(F.col("width"), F.col("height"), buckets)["bucket_id"])
    return d.withColumns({"bucket": pick(lambda b: b.name), "bw": pick(lambda b: b.width), "bh": pick(lambda b: b.height)})


def assign_by_join(images: DataFrame, buckets: DataFrame, key: str = "image_id") -> DataFrame:
    """The same with a bucket table that is only known as a DataFrame (at most 10,000 rows, checked, broadcast as one array): no row of images is multiplied or shuffled."""
    if buckets.limit(10_001).count() > 10_000:
        raise ValueError("a bucket table of more than 10,000 rows")
    row = F.struct("bucket_id", "bucket", F.ln(F.col("bw") / F.col("bh")).alias("r"))
    d = sound(images).crossJoin(F.broadcast(buckets.agg(F.sort_array(F.collect_list(row)).alias("__b"))))
    target = F.ln(F.col("width") / F.col("height"))
    best = F.array_min(F.transform("__b", lambda b: F.struct(F.abs(b["r"] - target).alias("d"), b["bucket_id"].alias("bucket_id"), b["bucket"].alias("bucket"))))
    return d.withColumn("m", best).where("m IS NOT NULL").select(key, "m.bucket_id", "m.bucket")


def counts(assigned: DataFrame, batch_size: int) -> DataFrame:
    return assigned.groupBy("bucket_id", "bucket").agg(F.count("*").alias("n_images")).withColumn("full_batches", F.floor(F.col("n_images") / batch_size))


def steps(per_bucket: DataFrame, accumulation: int, world: int = 1, epochs: int = 1) -> DataFrame:
    """Weight updates of an epoch and of all epochs: all floors, batches first, then ranks, then accumulation."""
    total = F.coalesce(F.sum("full_batches"), F.lit(0))
    n = F.floor(F.floor(total / max(world, 1)) / accumulation)
    return per_bucket.agg(total.alias("batches"), n.alias("steps_per_epoch")).withColumn("total_steps", F.col("steps_per_epoch") * epochs)
