"""Evaluation: feature moments, Frechet distance, per-bucket and overall reports, quick validation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import checkpoint
from .vq import usage

MIN_IMAGES, MIN_USAGE, DECIBEL_PLACES = 20, 0.5, 2
#: Tasks that add up what others found, before one task a tile does; columns in a tile.
PARTS, TILE = 64, 256

_TILE = "p int, whole boolean, g string, c string, i int, j int, n long, si array<double>, sj array<double>, m array<double>"
_SCHEMA = pa.schema(
    [("p", pa.int32()), ("whole", pa.bool_()), ("g", pa.string()), ("c", pa.string()), ("i", pa.int32()), ("j", pa.int32()), ("n", pa.int64()), ("si", pa.list_(pa.float64())), ("sj", pa.list_(pa.float64())), ("m", pa.list_(pa.float64()))]
)
_KEY = ["whole", "g", "c", "i", "j"]


def moment_tiles(features: DataFrame, columns: list[str], by: str | None = None) -> DataFrame:
    """whole, g, c, i, j, n, si, sj, m: for each group g (and for all, where whole), column c and tiles i <= j of ``TILE`` coordinates, the number of rows,
    the sums of both tiles' coordinates and the flattened sums of their products.

    One pass over all columns. A task sorts its own rows by group and holds the tiles of one group at a time; PARTS tasks add up what
    tasks found, tile by tile, and one task a tile the last PARTS. Nothing goes to the driver. Rows with a null feature are left out.
    """
    d = features.select((F.col(by) if by else F.lit(0)).cast("string").alias("g"), *(F.col(c).cast("array<double>").alias(c) for c in columns)).dropna(subset=columns)

    def row(whole: bool, g: str | None, c: str, i: int, j: int, n: int, si: np.ndarray, sj: np.ndarray, m: np.ndarray) -> pa.RecordBatch:
        values = [[TaskContext.get().partitionId()], [whole], [g], [c], [i], [j], [n], [si], [sj], [m.ravel()]]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, _SCHEMA.types, strict=True)], schema=_SCHEMA)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, n, tiles, totals = None, 0, {}, {}

        def given() -> Iterator[pa.RecordBatch]:
            for (c, i, j), m in tiles.items():
                for whole in (False, True):
                    yield row(whole, None if whole else of[0], c, i, j, n, totals[c, i], totals[c, j], m)

        for b in batches:
            g = b.column(0).to_pylist()
            cuts = [0, *(k for k in range(1, len(g)) if g[k] != g[k - 1]), len(g)]
            for start, end in zip(cuts, cuts[1:], strict=False):
                if start == end:
                    continue
                if of != (g[start],):
                    yield from given() if of else ()
                    of, n, tiles, totals = (g[start],), 0, {}, {}
                n += end - start
                for c in columns:
                    x = b.column(c).slice(start, end - start).flatten().to_numpy(zero_copy_only=False).reshape(end - start, -1)
                    cut = [x[:, k : k + TILE] for k in range(0, x.shape[1], TILE)]
                    for i, y in enumerate(cut):
                        totals[c, i] = totals.get((c, i), 0) + y.sum(0)
                        for j in range(i, len(cut)):
                            tiles[c, i, j] = tiles.get((c, i, j), 0) + y.T @ cut[j]
        yield from given() if of else ()

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, total = None, None
        for b in batches:
            keys = list(zip(*(b.column(k).to_pylist() for k in (*_KEY, "n")), strict=True))
            for k, (*key, n) in enumerate(keys):
                parts = [b.column(c)[k].values.to_numpy() for c in ("si", "sj", "m")]
                if key == of:
                    total = [total[0] + n, *(x + y for x, y in zip(total[1:], parts, strict=True))]
                    continue
                if of:
                    yield row(*of, *total)
                of, total = key, [n, *parts]
        if of:
            yield row(*of, *total)

    parts = d.sortWithinPartitions("g").mapInArrow(own, _TILE).withColumn("p", F.col("p") % PARTS)
    parts = parts.repartition("p", *_KEY).sortWithinPartitions("p", *_KEY).mapInArrow(added, _TILE)
    return parts.repartition(*_KEY).sortWithinPartitions(*_KEY, "p").mapInArrow(added, _TILE).drop("p")


def tile_covariance(n: int, si: np.ndarray, sj: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The tile's covariances (n - 1); of one row they are NaN."""
    with np.errstate(invalid="ignore", divide="ignore"):
        return (m.reshape(len(si), len(sj)) - np.outer(si, sj) / n) / np.float64(n - 1)


def moments(tiles: list[dict]) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, mean and covariance from the tiles of one group and column."""
    mean = np.concatenate([np.asarray(t["si"]) / t["n"] for t in sorted(tiles, key=lambda t: t["i"]) if t["i"] == t["j"]])
    cov = np.empty((len(mean), len(mean)))
    for t in tiles:
        x = tile_covariance(t["n"], np.asarray(t["si"]), np.asarray(t["sj"]), np.asarray(t["m"]))
        i, j = t["i"] * TILE, t["j"] * TILE
        cov[i : i + x.shape[0], j : j + x.shape[1]] = x
        cov[j : j + x.shape[1], i : i + x.shape[0]] = x.T
    return tiles[0]["n"], mean, cov


def covariance(features: DataFrame, column: str = "z") -> DataFrame:
    """i, j, cov of all features, tile by tile."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                si, sj, m = (b.column(c)[k].values.to_numpy() for c in ("si", "sj", "m"))
                x, i0, j0 = tile_covariance(b.column("n")[k].as_py(), si, sj, m), b.column("i")[k].as_py() * TILE, b.column("j")[k].as_py() * TILE
                i, j = np.repeat(i0 + np.arange(len(si)), len(sj)), np.tile(j0 + np.arange(len(sj)), len(si))
                yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(x.ravel())], ["i", "j", "cov"])
                if i0 != j0:
                    yield pa.RecordBatch.from_arrays([pa.array(j), pa.array(i), pa.array(x.ravel())], ["i", "j", "cov"])

    return moment_tiles(features, [column]).where("whole").mapInArrow(cells, "i bigint, j bigint, cov double")


def frechet_distance(mu1: np.ndarray, s1: np.ndarray, mu2: np.ndarray, s2: np.ndarray) -> float:
    """Squared distance of means plus trace(S1 + S2 - 2 sqrt(S1 S2)), by the symmetric form of the root."""
    w, v = np.linalg.eigh(s1)
    root = (v * np.sqrt(np.maximum(w, 0))) @ v.T
    inner = root @ s2 @ root
    cross = np.sqrt(np.maximum(np.linalg.eigvalsh((inner + inner.T) / 2), 0)).sum()
    return float((mu1 - mu2) @ (mu1 - mu2) + np.trace(s1) + np.trace(s2) - 2 * cross)


def frechet(pairs: DataFrame, by: str = "label", least: int = MIN_IMAGES) -> DataFrame:
    """bucket (null: all), num_images, rfid between features x and y; null below ``least`` images. One task a bucket holds that bucket's tiles."""

    def distance(t: pa.Table) -> pa.Table:
        whole, g, n = (t.column(c)[0].as_py() for c in ("whole", "g", "n"))
        rfid = None
        if n >= (2 if whole else least):
            rows = [{k: t.column(k)[r].as_py() for k in ("c", "i", "j", "n")} | {k: t.column(k)[r].values.to_numpy() for k in ("si", "sj", "m")} for r in range(t.num_rows)]
            (_, mu1, s1), (_, mu2, s2) = (moments([r for r in rows if r["c"] == c]) for c in "xy")
            rfid = frechet_distance(mu1, s1, mu2, s2)
        return pa.table({"whole": pa.array([whole]), "bucket": pa.array([g], pa.string()), "num_images": pa.array([n], pa.int64()), "rfid": pa.array([rfid], pa.float64())})

    return moment_tiles(pairs, ["x", "y"], by).groupBy("whole", "g").applyInArrow(distance, "whole boolean, bucket string, num_images bigint, rfid double").drop("whole")


def evaluation(images: DataFrame, by: str = "label", least: int = MIN_IMAGES) -> DataFrame:
    """Image-weighted means of l1 and psnr (and of perceptual, where there is one) for each bucket and for all (bucket null), and whether a bucket has enough images."""
    means = [c for c in ("l1", "psnr", "perceptual") if c in images.columns]
    d = images.select(F.col(by).cast("string").alias("bucket"), *means).rollup("bucket")
    d = d.agg(F.grouping("bucket").alias("g"), F.count("*").alias("num_images"), *(F.avg(c).alias(c) for c in means))
    return d.withColumn("enough", (F.col("g") == 1) | (F.col("num_images") >= least)).drop("g")


def evaluate(images: DataFrame, features: DataFrame, hist: DataFrame, by: str = "label", least: int = MIN_IMAGES) -> DataFrame:
    """The whole evaluation for each bucket and for all (bucket null): num_images, mean l1, psnr and perceptual, rfid, and on the row for all the codebook's usage.

    images: a row of metrics for each image; features: x and y of each image; hist: uses of each code. An
    evaluation without images raises ValueError.
    """
    e = checkpoint(evaluation(images, by, least).drop("enough"))
    # of rows without a bucket, that for all has the most images
    total = e.where("bucket IS NULL").agg(F.max("num_images")).first()[0]
    if not total:
        raise ValueError("there are no images to evaluate")
    f = frechet(features, by, least).select(F.col("bucket").alias("__of"), "rfid")
    used = usage(hist).select(F.struct("usage", "is_low").alias("u"))
    d = e.join(f, F.col("bucket").eqNullSafe(F.col("__of")), "left").drop("__of").withColumn("__used", used.scalar())
    every = F.col("bucket").isNull() & (F.col("num_images") == total)
    return d.withColumn("usage", F.when(every, F.col("__used.usage"))).withColumn("is_low", F.when(every, F.col("__used.is_low"))).drop("__used")


def report(evaluated: DataFrame) -> DataFrame:
    """Formatted lines (bucket, images, rfid, l1, psnr, codebook) of ``evaluate``, buckets in string order, then the row for all ("overall"), with a warning where few codes are used."""
    text = lambda c, n: F.format_string(f"%.{n}f", c)
    d = evaluated.orderBy(F.col("bucket").isNull(), "bucket")
    codebook = F.when(F.col("usage").isNull(), "").otherwise(F.concat(text("usage", 4), F.when(F.col("is_low"), " (low)").otherwise("")))
    return d.select(
        F.coalesce("bucket", F.lit("overall")).alias("bucket"), F.col("num_images").cast("string").alias("images"), F.when(F.col("rfid").isNull(), "n/a (few)").otherwise(text("rfid", 4)).alias("rfid"),
        text("l1", 4).alias("l1"), text("psnr", DECIBEL_PLACES).alias("psnr"), codebook.alias("codebook"),
    )


def quick_validation(plan: DataFrame, l1: DataFrame, key: str, bucket: str, batches: int = 40) -> DataFrame:
    """Batch-weighted mean of l1 over the first batches of a plan, for each bucket and for all (bucket null)."""
    per = plan.where(F.col("batch_no") < batches).join(l1, key).groupBy("batch_no", bucket).agg(F.avg("l1").alias("l1"))
    return per.select(F.col(bucket).cast("string").alias("bucket"), "l1").rollup("bucket").agg(F.count("*").alias("n_batches"), F.avg("l1").alias("recon_l1"))
