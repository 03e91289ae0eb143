"""The boundary to neural models: batch inference on Arrow batches. No weights are shipped.

``predict`` wraps any function of a float array [n, ...] (an encoder, decoder, perceptual
or feature network) as a column; the function is made once in each Python worker.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .vq import tokenize, untokenize


def predict(df: DataFrame, column: str, out: str, make: Callable[[], Callable[[np.ndarray], np.ndarray]], shape: list[int], batch_size: int = 64) -> DataFrame:
    """Adds array column ``out``: make()(batch) for the arrays of ``column``, reshaped to ``shape``; results are made flat."""

    def flat():
        f = make()
        return lambda x: np.asarray(f(x)).reshape(len(x), -1)

    f = predict_batch_udf(flat, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size, input_tensor_shapes=[shape])
    return df.withColumn(out, f(F.col(column).cast("array<float>")))


def encode(images: DataFrame, column: str, make: Callable[[], Callable[[np.ndarray], np.ndarray]], shape: list[int], codebook: DataFrame, height: int, width: int, out: str = "codes") -> DataFrame:
    """Adds the token grids of images: make() encodes batches to channels x height x width, and each place takes its nearest code."""
    return tokenize(predict(images, column, "__features", make, shape), codebook, height, width, "__features", out).drop("__features")


def decode(grids: DataFrame, column: str, make: Callable[[], Callable[[np.ndarray], np.ndarray]], shape: list[int], codebook: DataFrame, out: str = "image") -> DataFrame:
    """Adds the images that make() decodes from token grids; shape is channels, height, width of the features."""
    return predict(untokenize(grids, codebook, column, "__features"), "__features", out, make, shape).drop("__features")
