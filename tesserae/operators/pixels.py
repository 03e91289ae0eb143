"""From decoded images to model input: resize to cover a bucket, crop, flip, normalise.

Only what the crop shows is resampled. A pass is a banded matrix product: each output place has a few weights on
consecutive input places, and a block of places a small dense matrix. Weights are integers of 22 bits and pixels 8 bits
between the passes, as in the image library that is commonly used, so results are equal on any machine.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import scalars as S
from . import buckets as B
from .codebook import opened, store

BITS, BLOCK = 22, 64


def cubic(x: np.ndarray) -> np.ndarray:
    """The bicubic kernel with a = -1/2."""
    x = np.abs(x)
    return np.where(x < 1, (1.5 * x - 2.5) * x * x + 1, np.where(x < 2, ((2.5 - 0.5 * x) * x - 4) * x + 2, 0.0))


def bands(n_in: int, n_out: int, first: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """For the output places from ``first`` on: where their input begins, and their weights (zero where there are fewer), which add up to 1.

    The kernel is as wide as an output place where the size shrinks, so that every input counts.
    """
    scale = n_in / n_out
    wide = max(scale, 1.0)
    center = (np.arange(first, first + count) + 0.5) * scale
    low = np.maximum((center - 2 * wide + 0.5).astype(np.int64), 0)
    high = np.minimum((center + 2 * wide + 0.5).astype(np.int64), n_in)
    at = low[:, None] + np.arange((high - low).max())
    w = np.where(at < high[:, None], cubic((at - center[:, None] + 0.5) / wide), 0.0)
    return low, w / w.sum(1, keepdims=True)


def _pass(x: np.ndarray, low: np.ndarray, w: np.ndarray) -> np.ndarray:
    """x times the band matrix, along the last axis; whole numbers stay exact."""
    out = np.empty((*x.shape[:-1], len(low)))
    for i in range(0, len(low), BLOCK):
        start, rows = low[i : i + BLOCK], w[i : i + BLOCK]
        begin = start.min()
        end = min(x.shape[-1], start.max() + w.shape[1])
        m = np.zeros((end - begin + w.shape[1], len(start)))
        m[start - begin + np.arange(w.shape[1])[:, None], np.arange(len(start))] = rows.T
        out[..., i : i + BLOCK] = x[..., begin:end] @ m[: end - begin]
    return out


def resample(pixels: np.ndarray, new_w: int, new_h: int, left: int, top: int, width: int, height: int, whole: bool = True) -> np.ndarray:
    """The crop (left, top, width, height) of pixels (h x w x channels) resized to new_w x new_h; whole: in 8 bits, else in floats."""
    h, w, _ = pixels.shape
    columns, rows = bands(w, new_w, left, width), bands(h, new_h, top, height)
    if whole:
        columns, rows = ((low, np.floor(np.abs(k) * (1 << BITS) + 0.5) * np.sign(k)) for low, k in (columns, rows))
        scaled = lambda v: np.clip(np.floor((v + (1 << (BITS - 1))) / (1 << BITS)), 0, 255)
    else:
        scaled = lambda v: v
    first, last = rows[0].min(), min(h, rows[0].max() + rows[1].shape[1])
    x = scaled(_pass(pixels[first:last].transpose(0, 2, 1).astype(float), *columns))
    x = scaled(_pass(x.transpose(1, 2, 0), rows[0] - first, rows[1]))
    x = x.transpose(2, 1, 0)
    return x.astype(np.uint8) if whole else x


def placed(images: DataFrame, buckets=B.DEFAULT_BUCKETS, train: bool = True, flip: bool = True, seed: int = 42, epoch: int = 0, key: str = "image_id") -> DataFrame:
    """Adds bucket_id, bw, bh, new_w, new_h, left, top, flip: in training a crop and flip that follow from seed, epoch and key, else the centre."""
    d = B.assign(images, buckets).drop("bucket")
    w, h = S.cover_size(F.col("width"), F.col("height"), F.col("bw"), F.col("bh"), S.CROP_MARGIN if train else 1.0)
    d = d.withColumns({"new_w": w, "new_h": h})
    if not train:
        return d.withColumns({"left": S.center_offset(F.col("new_w"), F.col("bw")), "top": S.center_offset(F.col("new_h"), F.col("bh")), "flip": F.lit(False)})
    of = lambda name: S.hash_number(seed, epoch, F.col(key), name)
    return d.withColumns({"left": of("left") % (F.col("new_w") - F.col("bw") + 1), "top": of("top") % (F.col("new_h") - F.col("bh") + 1), "flip": (of("flip") % 2 == 1) if flip else F.lit(False)})


def fit(images: DataFrame, column: str = "rgb") -> DataFrame:
    """Replaces ``column`` (three bytes a pixel, row by row) of ``placed`` images by the crop that their numbers say, bw x bh; null stays null. No shuffle."""

    @F.pandas_udf(T.BinaryType())
    def cut(rgb: pd.Series, at: pd.DataFrame) -> pd.Series:
        out = []
        for x, r in zip(rgb, at.itertuples(index=False), strict=True):
            if x is None:
                out.append(None)
                continue
            p = np.frombuffer(x, np.uint8).reshape(int(r.height), int(r.width), 3)
            p = resample(p, int(r.new_w), int(r.new_h), int(r.left), int(r.top), int(r.bw), int(r.bh))
            out.append((p[:, ::-1] if r.flip else p).tobytes())
        return pd.Series(out, dtype=object)

    return images.withColumn(column, cut(column, F.struct("width", "height", "new_w", "new_h", "left", "top", "bw", "bh", "flip")))


def to_floats(rgb: np.ndarray) -> np.ndarray:
    """Bytes (n x h x w x 3) as n x 3 x h x w floats in [-1, 1]."""
    return ((rgb.astype(np.float32) / 255 - 0.5) / 0.5).transpose(0, 3, 1, 2)


def in_batches(loaded: DataFrame, f: Callable[[], Callable[[np.ndarray], list]], kind: str, out: str, column: str = "rgb") -> DataFrame:
    """Adds ``out`` to rows of a plan's batches (``sampler.load``): f() is made once a task and gets each batch, one bucket's shape, as n x 3 x h x w floats.

    A batch is held whole; the rows keep all columns but the pixels.
    """
    names = [c for c in loaded.columns if c != column]
    t = T.DataType.fromDDL(kind)

    def done(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, of, rows = f(), None, []

        def flush() -> pa.RecordBatch:
            shapes = {(r["bh"], r["bw"]) for r in rows}
            if len(shapes) != 1:
                raise ValueError(f"batch {of} has shapes {sorted(shapes)}")
            ((h, w),) = shapes
            x = to_floats(np.stack([np.frombuffer(r[column], np.uint8).reshape(h, w, 3) for r in rows]))
            table = pa.RecordBatch.from_pylist(rows, schema).select(names)
            return pa.RecordBatch.from_arrays([*table.columns, pa.array(model(x), to_arrow_type(t))], [*names, out])

        for b in batches:
            schema = b.schema
            for r in b.to_pylist():
                if r["batch_no"] != of:
                    if rows:
                        yield flush()
                    of, rows = r["batch_no"], []
                rows.append(r)
        if rows:
            yield flush()

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in loaded.schema if f.name != column)
    return loaded.mapInArrow(done, f"{fields}, `{out}` {kind}")


def encode_batches(loaded: DataFrame, make: Callable[[], Callable[[np.ndarray], np.ndarray]], codebook: DataFrame, out: str = "codes") -> DataFrame:
    """Adds the token grid of each image of a plan's batches: make() encodes n x 3 x h x w to n x channels x gh x gw, whatever h and w, and each place takes its nearest code."""
    path = store(codebook).path

    def of() -> Callable[[np.ndarray], list]:
        encoder, blocks = make(), opened(path)

        def grids(x: np.ndarray) -> list:
            z = np.asarray(encoder(x), float)
            n, c, gh, gw = z.shape
            return blocks.nearest(z.transpose(0, 2, 3, 1).reshape(-1, c))[0].reshape(n, gh, gw).tolist()

        return grids

    return in_batches(loaded, of, "array<array<bigint>>", out)
