"""Training telemetry: scalar rows, spikes, rolling speed, schedules, checkpoint retention."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import denormalize, every, side_by_side, warmup
from .ordering import rolling, rolling_mean
from .shared import checkpoint, exists

WINDOW, SPIKE = 50, 5.0


def scalars(steps: DataFrame, log_every: int = 50, always=("seconds",), logged=(), bucketed=("seconds",), system=()) -> DataFrame:
    """tag, step, value, in one pass over the steps.

    The columns ``always`` (train/*) and ``system`` (system/*) give a row for each step, ``logged`` (train/*)
    and ``bucketed`` (train_bucket_<bucket>/*) for each step that log_every divides. Null values give none.
    """
    due = every(F.col("step"), log_every)
    value = lambda prefix, c: F.struct(F.concat(prefix, F.lit(f"/{c}")).alias("tag"), F.col(c).cast("double").alias("value"))
    now = [value(F.lit(k), c) for k, columns in (("train", always), ("system", system)) for c in columns]
    then = [value(F.lit("train"), c) for c in logged] + [value(F.concat(F.lit("train_bucket_"), "bucket"), c) for c in bucketed]
    rows = steps.select("step", F.explode(F.array(*now, *(F.when(due, x) for x in then))).alias("row"))
    return rows.where("row.value IS NOT NULL").select("row.tag", "step", "row.value")


def validation_scalars(validated: DataFrame, step: int) -> DataFrame:
    """tag, step, value of ``metrics.quick_validation``'s rows: val/recon_l1, and val_bucket_<bucket>/recon_l1 for each bucket."""
    of = F.when(F.col("bucket").isNull(), F.lit("val")).otherwise(F.concat(F.lit("val_bucket_"), "bucket"))
    return validated.select(F.concat(of, F.lit("/recon_l1")).alias("tag"), F.lit(step).cast("bigint").alias("step"), F.col("recon_l1").alias("value"))


def image_grids(pairs: DataFrame, key: str, width: int, most: int = 4, bucket: str = "train") -> DataFrame:
    """tag, key, width, pixels of the first images by key: each input beside its reconstruction (columns x and y, flat, in [-1, 1]), as values in [0, 1]."""
    first = pairs.orderBy(key).limit(most)
    pixels = side_by_side(denormalize(F.col("x")), denormalize(F.col("y")), width)
    return first.select(F.lit(f"{bucket}/input_vs_reconstruction").alias("tag"), key, F.lit(2 * width).alias("width"), pixels.alias("pixels"))


def write_scalars(rows: DataFrame, path: str, span: int = 10_000) -> None:
    """Puts rows (tag, step, value) into a table that is partitioned by tag and by ``span`` steps; a (tag, step) that is there is replaced.

    Only partitions that the rows touch are read and written anew, from a checkpoint, by dynamic overwrite, so a repeated call changes
    nothing and an interrupted one can be repeated. Of several rows of a (tag, step) the greatest value stays.
    """
    spark = rows.sparkSession
    new = checkpoint(rows.groupBy("tag", "step").agg(F.max("value").alias("value")).withColumn("steps", F.floor(F.col("step") / span)))
    if exists(spark, path):
        old = spark.read.schema("step bigint, value double, tag string, steps bigint").parquet(path)
        old = old.join(new.select("tag", "steps").distinct(), ["tag", "steps"], "left_semi").join(new, ["tag", "step"], "left_anti")
        new = checkpoint(old.unionByName(new))
    new.repartition("tag", "steps").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("tag", "steps").parquet(path)


def spikes(steps: DataFrame, window: int = WINDOW, factor: float = SPIKE) -> DataFrame:
    """Steps that took more than factor times the mean of the steps before (window at most; never the first step)."""
    d = rolling_mean(steps, "step", "seconds", (-window, -1), "before")
    return d.where(F.col("seconds") > factor * F.col("before")).select("step", "seconds", "before")


def eta(steps: DataFrame, total_steps: int, window: int = WINDOW) -> DataFrame:
    """Mean seconds of the last steps, the current one included, and what is left at that speed."""
    d = rolling(steps, "step", (1 - window, 0), seconds_per_step=F.avg("seconds"))
    return d.select("step", "seconds_per_step", ((F.lit(total_steps) - F.col("step")) * F.col("seconds_per_step")).alias("eta_seconds"))


def learning_rates(steps: DataFrame, base: float = 4.5e-6, warmup_steps: int = 1500, start: int = 30_000) -> DataFrame:
    """Rates of both optimisers; the discriminator warms up from its own start."""
    s = F.col("step")
    active = s >= start
    return steps.select("step", (base * warmup(s, warmup_steps)).alias("lr_generator"), active.alias("discriminator_active"), F.when(active, base * warmup(s - start, warmup_steps)).otherwise(0.0).alias("lr_discriminator"))


def flags(batches: DataFrame, accumulation: int = 8, revive_every: int = 400, log_every: int = 50, image_every: int = 500, save_every: int = 2000, validate_every: int = 2000, revival: bool = True) -> DataFrame:
    """Per micro-batch (batch_idx from 0): whether it ends a step, and what is due at that step."""
    last = (F.col("batch_idx") + 1) % accumulation == 0
    step = F.floor((F.col("batch_idx") + 1) / accumulation)
    due = {"log": log_every, "image": image_every, "save": save_every, "validate": validate_every}
    return batches.select("batch_idx", step.alias("step"), last.alias("is_step"), (F.lit(revival) & last & every(step, revive_every)).alias("revive"), *((last & every(step, n)).alias(k) for k, n in due.items()))


def retained(checkpoints: DataFrame, keep_last: int = 5, milestone_every: int = 10_000) -> DataFrame:
    """Checkpoints that stay: the last ones and the milestones. Neither applies at 0 or below."""
    c = checkpoints.withColumn("milestone", every(F.col("step"), milestone_every))
    recent = c.orderBy(F.desc("step")).limit(max(keep_last, 0)).select("step", F.lit(True).alias("recent"))
    return c.join(F.broadcast(recent), "step", "left").withColumn("recent", F.coalesce("recent", F.lit(False))).where("recent OR milestone")


def resume_point(checkpoints: DataFrame, step: int | None = None) -> DataFrame:
    """The asked-for checkpoint, else the latest."""
    if step is not None:
        return checkpoints.where(F.col("step") == step)
    return checkpoints.orderBy(F.desc("step")).limit(1)

