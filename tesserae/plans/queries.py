"""The registered queries: each operator applied to the stand-in tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import buckets as B
from ..operators import embedding, losses, metrics, pixels, sampler, telemetry, vq
from ..operators.shared import checkpoint, fresh_path
from ..sources import catalog, config
from ..sources import fixtures as X
from ..streaming import quantizer

BATCH, WORLD, ACCUMULATION, SEED, EPOCH = 8, 2, 8, 42, 0
QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def r6(c) -> F.Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def assigned_images(spark, d):
    return B.assign(X.images(spark, d))


def tokens(spark, d):
    return vq.assign(X.vectors(spark, d), X.codebook(spark, d))


def pairs(spark, d):
    """vec_id, label, code, x (vector), y (its code's vector)."""
    t = vq.gather(tokens(spark, d), X.codebook(spark, d))
    return t.select("vec_id", "label", "code", F.col("z").alias("x"), F.col("e").alias("y"))


def image_metrics(spark, d):
    return metrics_of(pairs(spark, d))


def metrics_of(p):
    return p.select("vec_id", "label", S.mean_abs_diff(F.col("x"), F.col("y")).alias("l1"), S.psnr(F.col("x"), F.col("y")).alias("psnr"))


def the_plan(spark, d, total=False):
    return sampler.plan(assigned_images(spark, d), BATCH, SEED, EPOCH, total=total)


@query
def catalog_filter(spark: SparkSession, d: str) -> DataFrame:
    return X.paths(spark, d).where(catalog.is_image(F.col("path")))


@query
def catalog_count(spark, d):
    return catalog_filter(spark, d).agg(F.count("*").alias("n_images"))


@query
def catalog_order(spark, d):
    return catalog.ordered(catalog_filter(spark, d).select("path"), out="place").select("path", "place")


@query
def bucket_geometry(spark, d):
    """Geometry of the buckets that images take, and how many tokens those make."""
    n = assigned_images(spark, d).groupBy("bucket_id").agg(F.count("*").alias("n_images"))
    return B.geometry(B.table(spark)).join(n, "bucket_id").withColumn("total_tokens", F.col("n_images") * F.col("num_tokens"))


@query
def bucket_assign(spark, d):
    return assigned_images(spark, d).select("image_id", "width", "height", "bucket_id", "bucket")


@query
def bucket_assign_join(spark, d):
    return B.assign_by_join(X.images(spark, d), B.table(spark))


@query
def bucket_counts(spark, d):
    return B.counts(assigned_images(spark, d), BATCH)


@query
def steps_per_epoch(spark, d):
    return B.steps(bucket_counts(spark, d), ACCUMULATION, WORLD, epochs=30)


def covered(spark, d, margin):
    a = assigned_images(spark, d)
    w, h = S.cover_size(F.col("width"), F.col("height"), F.col("bw"), F.col("bh"), margin)
    return a.select("image_id", "bucket_id", "bw", "bh", w.alias("new_w"), h.alias("new_h"))


@query
def cover_geometry(spark, d):
    return covered(spark, d, 1.0)


@query
def cover_geometry_train(spark, d):
    return covered(spark, d, S.CROP_MARGIN)


@query
def center_crop_box(spark, d):
    c = covered(spark, d, 1.0)
    return c.select("image_id", S.center_offset(F.col("new_w"), F.col("bw")).alias("left"), S.center_offset(F.col("new_h"), F.col("bh")).alias("top"), "bw", "bh")


@query
def augment_plan(spark, d):
    c = covered(spark, d, S.CROP_MARGIN)
    i = F.col("image_id")
    return c.select(
        "image_id", (S.hash_number(SEED, EPOCH, i, "left") % (F.col("new_w") - F.col("bw") + 1)).alias("left"), (S.hash_number(SEED, EPOCH, i, "top") % (F.col("new_h") - F.col("bh") + 1)).alias("top"),
        (S.hash_number(SEED, EPOCH, i, "flip") % 2 == 1).alias("flip"),
    )


#: Buckets for the small images that are made of vectors.
SMALL_BUCKETS = (B.Bucket("1:1", 32, 32), B.Bucket("2:1", 64, 32))


def small_images(spark, d):
    """image_id, width, height, rgb: 60 coordinates of a vector as the bytes of 20 pixels, 4 x 5 or 10 x 2."""
    byte = lambda x: F.lpad(F.hex(F.floor(S.unit_range(x) * 255)), 2, "0")
    even = F.col("label") % 2 == 0
    return X.vectors(spark, d).select(
        F.col("vec_id").alias("image_id"), F.when(even, 4).otherwise(10).alias("width"), F.when(even, 5).otherwise(2).alias("height"), F.unhex(F.array_join(F.transform(F.slice("z", 1, 60), byte), "")).alias("rgb")
    )


def _sums():
    """For each image of a batch the sums of its bytes in each channel, plain and by place."""

    def sums(x):
        b = (((x + 1) / 2) * 255).round().astype("int64").reshape(len(x), 3, -1)
        place = 1 + np.arange(b.shape[2])
        return [[*map(int, i.sum(1)), *map(int, i @ place)] for i in b]

    return sums


@query
def model_input(spark, d):
    """Pixels in plan order: resized, cropped, flipped, normalised, a batch at a time."""
    i = pixels.placed(small_images(spark, d), SMALL_BUCKETS, seed=SEED, epoch=EPOCH)
    plan = sampler.plan(i, BATCH, SEED, EPOCH)
    loaded = sampler.load(plan, pixels.fit(i).select("image_id", "bw", "bh", "rgb"))
    m = pixels.in_batches(loaded, _sums, "array<bigint>", "sums")
    return m.select("batch_no", "pos", "bucket_id", "image_id", F.posexplode("sums").alias("i", "total")).withColumn("i", F.col("i").cast("bigint"))


def _cells():
    """Stands in for an encoder, whose weights are outside the engine: means of each channel over 32 x 32 places."""
    return lambda x: x.reshape(len(x), 3, x.shape[2] // 32, 32, x.shape[3] // 32, 32).astype("float64").mean((3, 5))


def colours(spark, d):
    """A codebook of three channels: the first coordinates of the first vectors."""
    return X.codebook(spark, d).select("code", F.slice("e", 1, 3).alias("e"))


def encoded(spark, d):
    i = pixels.placed(small_images(spark, d), SMALL_BUCKETS, seed=SEED, epoch=EPOCH)
    loaded = sampler.load(sampler.plan(i, BATCH, SEED, EPOCH), pixels.fit(i).select("image_id", "bw", "bh", "rgb"))
    return pixels.encode_batches(loaded, _cells, colours(spark, d))


@query
def encode_images(spark, d):
    """The token grid of each image of the plan."""
    e = encoded(spark, d).select("image_id", F.posexplode("codes").alias("y", "row"))
    e = e.select("image_id", "y", F.posexplode("row").alias("x", "code"))
    return e.select("image_id", F.col("y").cast("bigint").alias("y"), F.col("x").cast("bigint").alias("x"), "code")


@query
def decode_tokens(spark, d):
    """The features (channels, then places) of each token grid, as a decoder gets them."""
    f = vq.untokenize(encoded(spark, d).select("image_id", "codes"), colours(spark, d))
    return f.select("image_id", F.posexplode("z").alias("i", "v")).select("image_id", F.col("i").cast("bigint").alias("i"), r6("v").alias("value"))


@query
def normalize_roundtrip(spark, d):
    v = X.vectors(spark, d).select("vec_id", F.transform("z", S.unit_range).alias("pixels")).withColumn("values", S.normalize(F.col("pixels")))
    return v.select("vec_id", r6(S.array_sum(F.col("values"))).alias("norm_sum"), r6(S.mean_abs_diff(S.denormalize(F.col("values")), F.col("pixels"))).alias("back_diff"))


@query
def batch_plan(spark, d):
    return the_plan(spark, d)


@query
def rank_shards(spark, d):
    return sampler.shard(the_plan(spark, d, total=True), WORLD).select("rank", "local_no", "batch_no", "pos", "image_id")


@query
def resume_slice(spark, d):
    return sampler.resume(sampler.shard(the_plan(spark, d, total=True), WORLD), rank=1, offset=5).select("rank", "local_no", "batch_no", "pos", "image_id")


@query
def accum_windows(spark, d):
    return sampler.accumulate(sampler.shard(the_plan(spark, d, total=True), WORLD), ACCUMULATION)


@query
def eval_limit(spark, d):
    return sampler.first_per_bucket(assigned_images(spark, d).select("image_id", "bucket_id"), 2, BATCH)


@query
def vq_assign(spark, d):
    return tokens(spark, d).select("vec_id", "code", r6("d").alias("distance"))


@query
def vq_decode(spark, d):
    p = pairs(spark, d)
    return p.select("vec_id", "code", r6(F.element_at("y", 1)).alias("first"), r6(S.array_sum(F.col("y"))).alias("total"))


@query
def code_histogram(spark, d):
    return vq.histogram(tokens(spark, d), X.codebook(spark, d))


@query
def codebook_perplexity(spark, d):
    return vq.perplexity(code_histogram(spark, d)).select(r6("perplexity").alias("perplexity"))


@query
def codebook_usage(spark, d):
    return vq.usage(code_histogram(spark, d), metrics.MIN_USAGE).select("used", r6("usage").alias("usage"), "is_low")


@query
def usage_window(spark, d):
    return vq.usage_windows(tokens(spark, d), window_of())


def window_of():
    """A revival check every 100 vectors."""
    return F.floor(F.col("vec_id") / 100)


@query
def dead_codes(spark, d):
    return vq.dead_by_window(X.codebook(spark, d), tokens(spark, d), window_of())


@query
def revive_plan(spark, d):
    return vq.revive_by_window(dead_codes(spark, d), X.vectors(spark, d), window_of(), SEED)


@query
def ema_step(spark, d):
    e = vq.ema(X.codebook(spark, d), tokens(spark, d))
    e = e.select("code", "ema_n", F.posexplode("weight").alias("dim", "weight"))
    return e.select("code", F.col("dim").cast("bigint").alias("dim"), r6("ema_n").alias("ema_n"), F.round("weight", 5).alias("weight"))


def _long(c):
    return c.select("code", F.posexplode("e").alias("dim", "v")).select("code", F.col("dim").cast("bigint").alias("dim"), F.round("v", 5).alias("v"))


@query
def kmeans_step(spark, d):
    return _long(vq.kmeans(X.vectors(spark, d), X.codebook(spark, d), 1))


@query
def kmeans_3(spark, d):
    return _long(vq.kmeans(X.vectors(spark, d), X.codebook(spark, d), 3))


@query
def recon_l1(spark, d):
    return losses.reconstruction(pairs(spark, d)).select(r6("recon_l1").alias("recon_l1"))


@query
def vq_losses(spark, d):
    p = pairs(spark, d)
    both = [losses.quantizer(p, use_ema=e).select(F.lit(e).alias("use_ema"), r6("codebook_loss").alias("codebook_loss"), r6("commitment_loss").alias("commitment_loss"), r6("loss").alias("loss")) for e in (False, True)]
    return both[0].unionByName(both[1])


@query
def adv_losses(spark, d):
    """The halves of a vector stand in for the logits of 32 real and 32 reconstructed patches."""
    half = lambda i: F.slice("z", i, 32)
    v = X.vectors(spark, d).select(F.explode(F.arrays_zip(half(1).alias("real"), half(33).alias("fake"))).alias("p")).select("p.real", "p.fake")
    each = [v.agg(losses.generator_term(F.col("fake"), k).alias("g"), losses.discriminator_term(F.col("real"), F.col("fake"), k).alias("d")).select(F.lit(k).alias("kind"), r6("g").alias("generator"), r6("d").alias("discriminator")) for k in losses.KINDS]
    return each[0].unionByName(each[1])


@query
def adaptive_weight(spark, d):
    p = pairs(spark, d)
    return p.select("vec_id", r6(losses.adaptive_weight(F.col("x"), F.zip_with("x", "y", lambda a, b: a - b))).alias("weight"))


@query
def loss_total(spark, d):
    p = pairs(spark, d)
    x, y = F.col("x"), F.col("y")
    t = losses.total(S.mean_abs_diff(x, y), S.mean_sq_diff(x, y) * 1.15, F.col("label") / 10, -F.element_at(x, 1), F.col("vec_id"), start=100)
    return p.select("vec_id", r6(t).alias("total"))


@query
def psnr_by_bucket(spark, d):
    return image_metrics(spark, d).groupBy("label").agg(F.avg("psnr").alias("p")).select("label", r6("p").alias("psnr"))


@query
def feature_covariance(spark, d):
    return metrics.covariance(X.vectors(spark, d)).select("i", "j", r6("cov").alias("cov"))


@query
def frechet(spark, d):
    return metrics.frechet(pairs(spark, d))


@query
def eval_rollup(spark, d):
    return metrics.evaluation(image_metrics(spark, d)).select("bucket", "num_images", r6("l1").alias("l1"), r6("psnr").alias("psnr"), "enough")


@query
def eval_report(spark, d):
    # what all parts of the report read: codes are looked for once
    p = checkpoint(pairs(spark, d))
    hist = vq.histogram(p.select("code"), X.codebook(spark, d))
    return metrics.report(metrics.evaluate(metrics_of(p), p, hist))


@query
def kmeans_start(spark, d):
    c = vq.kmeans_init(X.vectors(spark, d), X.codebook(spark, d), 2, SEED)
    return _long(c.where("started AND ema_n = 1 AND ema_sum = e"))


@query
def revive_codes(spark, d):
    """The codebook after the revival checks of all windows (a code that was dead several times has the last vector), with moving averages and counters."""
    book = X.codebook(spark, d).select("code", "e", F.lit(5.0).alias("ema_n"), F.col("e").alias("ema_sum"), F.lit(9).cast("bigint").alias("usage"))
    plan = revive_plan(spark, d).groupBy("code").agg(F.max_by("vec_id", "window_no").alias("vec_id"))
    r = vq.revived(book, plan, X.vectors(spark, d))
    return r.select("code", r6(S.array_sum(F.col("e"))).alias("total"), r6(S.array_sum(F.col("ema_sum"))).alias("ema_total"), "ema_n", "usage")


@query
def quick_validation(spark, d):
    m = image_metrics(spark, d)
    plan = sampler.plan(X.vectors(spark, d), BATCH, SEED, EPOCH, drop_last=False, key="vec_id", bucket="label")
    v = metrics.quick_validation(plan, m.select("vec_id", "l1"), "vec_id", "label")
    return v.select("bucket", "n_batches", r6("recon_l1").alias("recon_l1"))


@query
def telemetry_long(spark, d):
    return telemetry.scalars(X.telemetry(spark, d))


@query
def telemetry_families(spark, d):
    """Tags of each step (seconds, epoch) and of each 50th (learning rate, seconds of the bucket)."""
    t = X.telemetry(spark, d).withColumn("epoch", F.floor(F.col("step") / 3000)).withColumn("lr_generator", F.round(S.warmup(F.col("step"), 1500), 6))
    return telemetry.scalars(t, always=("seconds", "epoch"), logged=("lr_generator",))


@query
def validation_scalars(spark, d):
    return telemetry.validation_scalars(quick_validation(spark, d), 2000)


@query
def image_grid(spark, d):
    """Vectors stand in for images of 8 x 8."""
    g = telemetry.image_grids(pairs(spark, d), "vec_id", 8)
    return g.select("tag", "vec_id", F.posexplode("pixels").alias("i", "v")).select("tag", "vec_id", F.col("i").cast("bigint").alias("i"), r6("v").alias("value"))


@query
def checkpoint_json(spark, d):
    """Checkpoints as JSON text and read back."""
    c = X.checkpoints(spark, d).select(F.to_json(F.struct("step", "epoch", "batch_offset")).alias("text"))
    return c.select("text", F.from_json("text", "step bigint, epoch bigint, batch_offset bigint").alias("c")).select("text", "c.step", "c.batch_offset")


@query
def step_spikes(spark, d):
    return telemetry.spikes(X.telemetry(spark, d)).select("step", "seconds", r6("before").alias("before"))


@query
def eta_rolling(spark, d):
    t = telemetry.eta(X.telemetry(spark, d), total_steps=1_000_000)
    return t.select("step", r6("seconds_per_step").alias("seconds_per_step"), F.round("eta_seconds", 3).alias("eta_seconds"))


def steps(spark, d):
    return X.telemetry(spark, d).select((F.col("step") * 40).alias("step"))


@query
def lr_schedule(spark, d):
    t = telemetry.learning_rates(steps(spark, d))
    return t.select("step", F.round(F.col("lr_generator") * 1e6, 6).alias("lr_generator_e6"), "discriminator_active", F.round(F.col("lr_discriminator") * 1e6, 6).alias("lr_discriminator_e6"))


@query
def schedule_flags(spark, d):
    return telemetry.flags(X.telemetry(spark, d).select((F.col("step") - 1).alias("batch_idx")), revive_every=100)


@query
def format_duration(spark, d):
    t = X.telemetry(spark, d)
    return t.select("step", S.format_duration((F.col("seconds") - 10) * 97).alias("text"))


@query
def ckpt_retention(spark, d):
    return telemetry.retained(X.checkpoints(spark, d), 5, 1000)


@query
def resume_point(spark, d):
    return telemetry.resume_point(X.checkpoints(spark, d))


def settings(spark, d, given):
    """key, value: fields of runs (users), by their latest event among those of even or odd ids; some of the odd ones are null."""
    e = spark.read.parquet(f"{d}/events.parquet").where(F.col("event_id") % 2 == int(given))
    field = F.when(F.col("event_type") == "click", "codebook_size").when(F.col("event_type") == "view", "use_ema").otherwise(F.col("event_type"))
    n = F.round(F.col("value") * 100).cast("bigint")
    value = F.when((n % 3 == 0) & F.lit(given), None).otherwise(n.cast("string"))
    return e.select(F.concat(F.lit("run"), F.col("user_id").cast("string"), F.lit("."), field).alias("key"), F.struct("event_id", value.alias("value")).alias("v")).groupBy("key").agg(F.max("v").alias("v")).select("key", "v.value")


@query
def config_overlay(spark, d):
    return config.overlay(settings(spark, d, False), settings(spark, d, True))


@query
def config_diff(spark, d):
    return config.differences(settings(spark, d, False), settings(spark, d, True)).withColumn("critical", F.substring_index("key", ".", -1).isin(*config.CRITICAL))


@query
def pos_embedding(spark, d):
    """Vectors as tokens of grids of 4 x 6: their first 16 channels with the position added."""
    i = F.col("vec_id")
    v = X.vectors(spark, d).select("vec_id", (F.floor(i / 6) % 4).alias("y"), (i % 6).alias("x"), F.posexplode(F.slice("z", 1, 16)).alias("c", "v")).withColumn("c", F.col("c").cast("bigint"))
    # 384 rows
    p = F.broadcast(embedding.positions(spark, 4, 6, 16))
    return v.join(p, ["c", "y", "x"]).select("vec_id", "c", r6(F.col("v") + F.col("value")).alias("value"))


@query
def quantizer_steps(spark, d):
    """The codebook after two training steps, on the vectors of even and then of odd ids."""
    root = fresh_path(spark, "quantizer")
    quantizer.start(X.codebook(spark, d), root)
    for k in range(2):
        quantizer.step(X.vectors(spark, d).where(F.col("vec_id") % 2 == k), root, k)
    return quantizer.version(spark, root).select("code", r6("ema_n").alias("ema_n"), "usage", F.round(S.array_sum(F.col("e")), 5).alias("total"), F.round(S.array_sum(F.col("ema_sum")), 5).alias("ema_total"))


@query
def swish(spark, d):
    v = X.vectors(spark, d).select("vec_id", F.posexplode("z").alias("i", "v"))
    return v.select("vec_id", F.col("i").cast("bigint").alias("i"), r6(S.swish(F.col("v"))).alias("value"))
