"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each whole text becomes 16 statistics, transformed (logs, square roots of shares) towards
normal shape. A class has a mean and a covariance shrunk towards the pooled diagonal; the
Cholesky factors are computed once and cached in the model. The score is the logistic of
the difference of Mahalanobis log densities plus the log prior ratio, on a signed logarithmic
scale whose slope and offset are fitted to the training rows (through a histogram of some
hundreds of bins).

Training takes the labelled rows outside the held-out quarter (crc32 of the id as text, mod 4,
is 2): all of them up to ``LABELS`` ids, beyond that about as many by a hash of the id. So the set of
ids that training needs is bounded and broadcast, and only their texts are measured for it; moments
are sums that at most ``TRAINERS`` tasks return. Scoring measures every text once, where it lies:
nothing is shuffled. Ids stay 64-bit integers in the JVM; Python sees texts only.

Edge cases: null and empty texts count as empty and are scored like others; a text of any length is
measured whole; labels that are null or neither 0 nor 1 are left out, and an id with both labels
counts as 0; rows that repeat a labelled id all train; a class without rows takes the moments of the
other (no rows at all: every score is the prior 0.5); null ids are scored and never held out; repeated
rows get the same score; an empty table gives no rows; other columns, whatever their names, are
ignored by ``classify`` and kept by ``accepted``. label, lang, source and doc_id are not inputs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpoint, read_table, text_bytes

NAMES = (
    "log_words", "log_word_chars", "distinct_words", "upper", "symbols", "exclaims", "digits", "lines", "dup_lines", "dup_windows",
    "dup_pairs", "stops", "commas", "non_ascii", "longest_word", "pair_runs",
)
D = len(NAMES)
TRAINERS, LABELS = 64, 200_000
THRESHOLD = 0.7
_CLASSES = np.zeros((256, 8), np.int64)
for _i, _set in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "#*$%&|<>@~^_{}[]", "!?", "0123456789", "\n", ".", ",;:")):
    _CLASSES[list(map(ord, _set)), _i] = 1
_CLASSES[128:, 7] = 1


def statistics(text: bytes) -> list[float]:
    """The transformed statistics of one text."""
    w = text.split()
    n = len(w)
    if not n:
        return [0.0] * D
    upper, symbols, exclaims, digits, newlines, stops, commas, high = (np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _CLASSES).tolist()
    chars = sum(map(len, w))
    lines = [x for x in text.split(b"\n") if x.strip()]
    two, three = set(zip(w, w[1:])), set(zip(w, w[1:], w[2:]))  # noqa: B905
    runs = sum(x == y for x, y in zip(w, w[1:]))  # noqa: B905
    share = lambda a, b: (max(a, 0) / b) ** 0.5 if b > 0 else 0.0
    return [
        np.log1p(n), np.log(chars / n), np.log(len(set(w)) + 1) / np.log(n + 1), share(upper, chars), min(2.0, share(symbols, n)), min(2.0, share(exclaims, n)), share(digits, chars),
        min(2.0, share(newlines, n)), share(len(lines) - len(set(lines)), len(lines)), share(n - 2 - len(three), n - 2), share(n - 1 - len(two), n - 1), min(2.0, share(stops, n)),
        min(2.0, share(commas, n)), share(high, chars), np.log1p(max(map(len, w))), share(runs, n),
    ]


def _matrix(texts) -> np.ndarray:
    return np.array([statistics(t) for t in texts], np.float64).reshape(-1, D)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _statistics(texts: pd.Series) -> pd.Series:
    return pd.Series(list(_matrix(texts)))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


@dataclass(frozen=True)
class Model:
    """Per class: log prior, mean, inverse Cholesky factor of the covariance, half its log determinant."""

    priors: tuple[float, float]
    means: np.ndarray
    factors: np.ndarray
    logdets: tuple[float, float]
    slope: float = 1.0
    offset: float = 0.0

    def ratio(self, x: np.ndarray) -> np.ndarray:
        """The log density ratio of class 1 to class 0, on a signed logarithmic scale."""
        dens = [self.priors[c] - 0.5 * (((x - self.means[c]) @ self.factors[c].T) ** 2).sum(1) - self.logdets[c] for c in (0, 1)]
        return np.sign(dens[1] - dens[0]) * np.log1p(np.abs(dens[1] - dens[0]))

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.round(1 / (1 + np.exp(-np.clip(self.slope * self.ratio(x) + self.offset, -40, 40))), 9)


def calibrate(x: np.ndarray, y: np.ndarray, n: np.ndarray, prior: float = 1.0) -> tuple[float, float]:
    """Slope and offset of a logistic curve through counted (x, y), by Newton steps with a weak normal prior."""
    z, t = np.column_stack([x, np.ones(len(x))]), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ t, -40, 40)))
        grad = z.T @ (n * (p - y)) + prior * (t - [1.0, 0.0])
        step = np.linalg.solve((z * (n * p * (1 - p))[:, None]).T @ z + prior * np.eye(2), grad)
        t = t - step * min(1.0, 1.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-10:
            break
    return round(float(t[0]), 9), round(float(t[1]), 9)


def _rows(x: pa.Array) -> np.ndarray:
    return x.flatten().to_numpy(zero_copy_only=False).reshape(-1, D)


def fit(labelled: DataFrame, own: float = 0.7, ridge: float = 0.02) -> Model:
    """labelled: quality and x. own: weight of a class's own covariance against the pooled diagonal."""

    def moments(batches):
        total = {c: np.zeros((D + 1, D + 1)) for c in (0, 1)}
        for b in batches:
            x = np.column_stack([np.ones(b.num_rows), _rows(b.column(1))])
            y = b.column(0).to_numpy()
            for c in (0, 1):
                total[c] += x[y == c].T @ x[y == c]
        yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array([total[0].ravel(), total[1].ravel()], pa.list_(pa.float64()))], ["c", "m"])

    parts = labelled.select(F.col("quality").cast("int"), "x").coalesce(TRAINERS).mapInArrow(moments, "c int, m array<double>").collect()
    m = np.zeros((2, D + 1, D + 1))
    for p in sorted(parts, key=lambda r: (r.c, r.m)):
        m[p.c] += np.array(p.m).reshape(D + 1, D + 1)
    n = m[:, 0, 0]
    if not n.sum():
        return Model((0.0, 0.0), np.zeros((2, D)), np.stack([np.eye(D)] * 2), (0.0, 0.0))
    for c in (0, 1):
        if not n[c]:
            m[c] = m[1 - c]
    mean = np.stack([m[c, 0, 1:] / m[c, 0, 0] for c in (0, 1)])
    cov = np.stack([m[c, 1:, 1:] / m[c, 0, 0] - np.outer(mean[c], mean[c]) for c in (0, 1)])
    pooled = np.diag((m[:, 0, 0, None, None] * cov).sum(0) / m[:, 0, 0].sum())
    chol = []
    for c in (0, 1):
        shrunk = own * cov[c] + np.diag((1 - own) * np.diag(cov[c]) + ridge * pooled + 1e-4)
        chol.append(np.linalg.cholesky(shrunk))
    prior = np.log((n + 1) / (n.sum() + 2))
    return Model(tuple(prior.tolist()), mean, np.stack([np.linalg.inv(x) for x in chol]), tuple(float(np.log(np.diag(x)).sum()) for x in chol))


def known_labels(labels: DataFrame, most: int = LABELS) -> DataFrame:
    """doc_id, quality to train on: one row an id, at most about ``most`` of them."""
    y = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"))
    y = checkpoint(y.where(~held_out()))
    n = y.count()
    return y if n <= most else y.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(most / n * (1 << 30)))


def train(docs: DataFrame, labels: DataFrame, most: int = LABELS) -> Model:
    """A calibrated model from documents and their labels (doc_id, quality)."""
    y = F.broadcast(known_labels(labels, most).withColumnRenamed("doc_id", "__of"))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(y, F.col("doc_id") == F.col("__of"))
    known = checkpoint(d.select("quality", _statistics(text_bytes()).alias("x")))
    model = fit(known)

    def rated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.round(model.ratio(_rows(b.column(1))) * 20).astype(np.int32))], ["quality", "bin"])

    bins = known.select("quality", "x").mapInArrow(rated, "quality int, bin int").groupBy("quality", "bin").count().orderBy("quality", "bin").toPandas()
    if not len(bins):
        return model
    slope, offset = calibrate(bins["bin"].to_numpy() / 20, bins["quality"].to_numpy(), bins["count"].to_numpy())
    return replace(model, slope=slope, offset=offset)


def score_of(model: Model) -> Column:
    """The score of the column text."""

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(_matrix(texts)))

    return scored(text_bytes())


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs."""
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").select("doc_id", held_out().alias("held_out"), score_of(train(docs, labels)).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are predicted 1, judged where they lie."""
    return docs.where(score_of(train(docs, labels)) >= THRESHOLD)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
